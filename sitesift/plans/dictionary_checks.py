"""Registered queries of dictionaries as tables, and their oracle SQL.

The dictionary holds thousands of keywords taken from ``part`` and ``documents`` (it grows
with them); the SQL finds the same rows by other means: every n-gram in a list, every pair
compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.operators import structure as S
from sitesift.operators import vocabulary as V
from sitesift.operators.htmltree import parse_pages
from sitesift.plans.checks import T, query, sql_clean

# part names; of every document its third and fourth word, of some its fifth
VOCABULARY_SQL = """
SELECT p_name AS keyword, p_partkey AS ord FROM part
UNION ALL SELECT split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4), 1000000000 + doc_id FROM documents
UNION ALL SELECT split_part(text, ' ', 5), 2000000000 + doc_id FROM documents WHERE doc_id % 3 = 0
"""


def _vocabulary(spark, d):
    for t in ("part", "documents"):
        T(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(VOCABULARY_SQL)


W = r"\p{L}\p{M}\p{N}_"
TOKENS = f"'[{W}]+|[^{W}]'"
EXACT_SQL = f"""
WITH RECURSIVE d AS (SELECT lower(keyword) AS gram, min(ord) AS ord FROM ({VOCABULARY_SQL}) v WHERE keyword <> '' GROUP BY 1),
dm AS (SELECT gram, ord, len(regexp_extract_all(gram, {TOKENS})) AS m, regexp_extract(gram, {TOKENS}) AS first FROM d),
fm AS (SELECT DISTINCT first, m FROM dm),
t AS (SELECT doc_id, {sql_clean('text')} AS ct FROM documents),
tk AS (SELECT doc_id, unnest(x) AS tok, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(ct, {TOKENS}) AS x FROM t) u),
tp AS (SELECT doc_id, i, tok, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM tk),
c AS (SELECT a.doc_id, a.i, fm.m, CAST(a.e - length(a.tok) AS BIGINT) AS s, CAST(z.e AS BIGINT) AS e FROM tp a JOIN fm ON lower(a.tok) = fm.first
      JOIN tp z ON z.doc_id = a.doc_id AND z.i = a.i + fm.m - 1),
g AS (SELECT doc_id, {{'i': i, 'm': m, 'value': substr(ct, s + 1, e - s), 'b': CASE WHEN s > 0 THEN substr(ct, s, 1) ELSE '' END,
        'a': substr(ct, e + 1, 1)}} AS g FROM c JOIN t USING (doc_id)),
h AS (SELECT doc_id, g.i AS i, g.m AS m, g.value AS value, ord FROM g JOIN dm ON dm.m = g.m AND dm.gram = lower(g.value)
      WHERE (regexp_matches(g.value, '^[{W}]') OR regexp_matches(g.b, '^[{W}]'))
        AND (regexp_matches(g.value, '[{W}]$') OR regexp_matches(g.a, '^[{W}]'))),
best AS (SELECT doc_id, i, arg_min(m, ord) AS m, arg_min(value, ord) AS value FROM h GROUP BY 1, 2),
nx AS (SELECT b.doc_id, b.i, b.value, c.i AS nxt FROM best b ASOF LEFT JOIN best c ON b.doc_id = c.doc_id AND b.i + b.m <= c.i),
r AS (SELECT doc_id, min(i) AS i, 0 AS pos FROM best GROUP BY 1
      UNION ALL SELECT r.doc_id, nx.nxt, r.pos + 1 FROM r JOIN nx ON nx.doc_id = r.doc_id AND nx.i = r.i WHERE nx.nxt IS NOT NULL)
SELECT r.doc_id, CAST(r.pos AS INTEGER) AS pos, nx.value FROM r JOIN nx ON nx.doc_id = r.doc_id AND nx.i = r.i
"""


@query("x_title_exact_table", EXACT_SQL)
def q_x_title_exact_table(spark, d):
    """Whole-word titles of a dictionary of thousands of keywords in all documents."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    return V.exact_titles(docs, F.col("text"), _vocabulary(spark, d), ids=("doc_id",))


# short texts (for which the edit distance counts) and every document
FUZZY_TEXTS_SQL = """
SELECT doc_id AS id, text FROM documents
UNION ALL SELECT -1 - p_partkey, 'a ' || replace(p_name, 'e', 'o') || ' end' FROM part WHERE p_partkey % 20 = 0
"""
FUZZY_SQL = f"""
WITH dict AS (SELECT keyword AS kw, ord, trim(regexp_replace(lower(keyword), '[^a-z0-9]', ' ', 'g')) AS kp FROM ({VOCABULARY_SQL}) v),
dk AS (SELECT * FROM dict WHERE kp <> ''),
tx AS (SELECT id, list_filter(string_split({sql_clean('text')}, ' '), lambda x: x <> '') AS w FROM ({FUZZY_TEXTS_SQL}) f),
q AS (SELECT id, trim(regexp_replace(lower(array_to_string(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), ' ')),
      '[^a-z0-9]', ' ', 'g')) AS qp FROM tx WHERE len(w) > 3),
kw AS (SELECT DISTINCT ord, kw, unnest(string_split_regex(kp, ' +')) AS w FROM dk WHERE contains(kp, ' ')),
qw AS (SELECT DISTINCT id, unnest(string_split_regex(qp, ' +')) AS w FROM q),
sc AS (SELECT id, ord, kw, 60 AS score FROM q, dk WHERE contains(qp, kp)
       UNION ALL SELECT id, ord, kw, 57 FROM qw JOIN kw USING (w)
       UNION ALL SELECT id, ord, kw, least(56, CAST(round(100.0 * (1.0 - levenshtein(kp, qp) / greatest(length(kp), length(qp)))) AS INTEGER))
       FROM q JOIN dk ON length(qp) <= 4 * length(kp) AND length(kp) <= 4 * length(qp)),
best AS (SELECT id, ord, kw, max(score) AS score FROM sc GROUP BY ALL HAVING max(score) > 30)
SELECT id, CAST(rk AS INTEGER) AS rk, kw AS value, score FROM (
  SELECT id, kw, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rk FROM best) x WHERE rk <= 5
"""


@query("x_title_fuzzy_table", FUZZY_SQL)
def q_x_title_fuzzy_table(spark, d):
    """The five best fuzzy titles of a dictionary of thousands of keywords for each text."""
    words = _vocabulary(spark, d)
    return V.fuzzy_titles(spark.sql(FUZZY_TEXTS_SQL), F.col("text"), words, ids=("id",))


# context words and URL words: parts of customer names' numbers and of words in documents
CONTEXT_SQL = """
SELECT lower(split_part(text, ' ', 6)) || '-' || CAST(doc_id % 100 AS string) AS keyword, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS weight,
       CAST(doc_id AS bigint) AS ord FROM documents WHERE split_part(text, ' ', 6) <> ''
UNION ALL SELECT CAST(c_custkey AS string), 'low', 1000000000 + c_custkey FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT lower(c_mktsegment) || '/', 'high', 2000000000 + c_custkey FROM customer WHERE c_custkey <= 3
"""
CONTEXT_PAGES_SQL = """
SELECT c_custkey AS page_id, 'http://x/' || CAST(c_custkey AS string) AS url, 'Box-' || c_mktsegment || '/' || CAST(c_custkey * 7 AS string) AS cls,
       'n' || CAST(c_custkey AS string) AS idv FROM customer
UNION ALL SELECT -1 - doc_id, 'http://y/' || CAST(doc_id AS string), replace(replace(split_part(text, ' ', 6), '"', ''), '&', '') || '-' || CAST(doc_id % 100 AS string), ''
FROM documents
"""


def _context(spark, d):
    for t in ("customer", "documents"):
        T(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(CONTEXT_SQL)


@query("html_context_table", f"""
SELECT page_id, via, keyword, weight, ord FROM (
  SELECT page_id, 'class' AS via, lower(cls) AS attr FROM ({CONTEXT_PAGES_SQL}) p UNION ALL
  SELECT page_id, 'id', lower(idv) FROM ({CONTEXT_PAGES_SQL}) p) a
JOIN (SELECT keyword, arg_min(weight, ord) AS weight, min(ord) AS ord FROM ({CONTEXT_SQL}) c GROUP BY keyword) k
  ON contains(attr, keyword) WHERE attr <> ''
""")
def q_html_context_table(spark, d):
    """Context blocks by a keyword table that grows with the data."""
    ctx = _context(spark, d)
    pages = spark.sql(CONTEXT_PAGES_SQL).select("page_id", "url", F.concat(
        F.lit('<div class="'), "cls", F.lit('" id="'), "idv", F.lit('">T</div>')).alias("html"))
    return S.context_blocks(parse_pages(pages), ctx).select("page_id", "via", "keyword", "weight", "ord")


RELEVANCE_SQL = """
SELECT c_custkey AS page_id, 'http://h.example.com/' || lower(c_mktsegment) || '/' || CAST(c_custkey AS string) || '/x' AS url,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'See ' || c_name END AS text FROM customer
"""


@query("crawl_relevance_table", f"""
SELECT page_id, (CASE WHEN EXISTS (SELECT 1 FROM ({CONTEXT_SQL}) k WHERE contains(lower(substr(url, 21)), keyword)) THEN 5 ELSE 0 END)
  + (CASE WHEN EXISTS (SELECT 1 FROM ({CONTEXT_SQL}) k WHERE contains(lower(coalesce(text, '')), keyword)) THEN 3 ELSE 0 END) AS score
FROM ({RELEVANCE_SQL}) u
""")
def q_crawl_relevance_table(spark, d):
    """Link relevance by a keyword table that grows with the data."""
    from sitesift.operators.crawl import with_relevance
    words = _context(spark, d).select("keyword", "ord")
    return with_relevance(spark.sql(RELEVANCE_SQL), "url", "text", "score", words).select("page_id", "score")
