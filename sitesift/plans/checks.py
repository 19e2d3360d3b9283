"""Registered queries (one per operator of the inventory) and their oracle SQL.

Each query takes (spark, sf_dir) and reads the given tables, or data Spark
derives from them, in full. The oracle SQL is written independently in
DuckDB's dialect (RE2 regex, no HTML parser) over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.dictionaries import (BASE_CONFIDENCE, CONTEXT_KEYWORDS, DEFAULT_TITLES, URL_KEYWORDS, WEIGHT_FACTOR,
                                   WRAPPER_TITLES)
from sitesift.functions import patterns as P
from sitesift.functions.text import clean_text, find_all
from sitesift.functions.urls import (is_html_url, normalize_url, with_joined_url, url_fragment, url_netloc,
                                     url_path, url_query, url_scheme)
from sitesift.operators import structure as S
from sitesift.operators.extract import explode_matches, text_mentions
from sitesift.operators.htmltree import parse_pages, parse_problems
from sitesift.session import deal, stored
from sitesift.sources.readers import fetched_ok, read_table, seeds_from_lines

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def T(spark, d, name):
    return read_table(spark, d, name)


def _docs(spark, d):
    return T(spark, d, "documents").select("doc_id", "text")


# ---------------------------------------------------------------- SQL helpers
def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_clean(col):
    return (f"(CASE WHEN trim(regexp_replace({col}, '\\s+', ' ', 'g')) = '' THEN {col} "
            f"ELSE trim(regexp_replace({col}, '\\s+', ' ', 'g')) END)")


ASCII_US = "regexp_replace({c}, '[^\\x00-\\x7F]', '_', 'g')"
RE2_NAME = r"\b(?:Dr\.|Mr\.|Ms\.|Mrs\.|Prof\.)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
RE2_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
RE2_PHONE = r"\+?[\d\s.-]+\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"


def re2_titles(keywords):
    return "(?i)\\b(" + "|".join(keywords) + ")\\b"


def sql_explode(select_ids, arr_expr, from_sql, value="value", pos=True):
    """rows (ids, pos, value) for every element of a list expression."""
    p = f", CAST(generate_subscripts(_a, 1) - 1 AS INTEGER) AS pos" if pos else ""
    return (f"SELECT {select_ids}{p}, unnest(_a) AS {value} FROM "
            f"(SELECT {select_ids}, {arr_expr} AS _a FROM {from_sql}) _x")


# ================================================================ sources
# seed lines: hosts between tabs and spaces, and lines of white space alone
SEED_LINES_SQL = """
SELECT chr(9) || ' ' || regexp_replace(url, '^https?://', '') || ' ' || chr(9) AS value FROM pages
UNION ALL SELECT ' ' || url FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT chr(9) || ' ' FROM pages WHERE page_id % 5 = 0
"""


@query("src_seeds", """
SELECT CASE WHEN starts_with(s, 'http') THEN s ELSE 'http://' || s END AS seed
FROM (SELECT trim(value, ' ' || chr(9)) AS s FROM (""" + SEED_LINES_SQL + """) l) t WHERE s <> ''
""")
def q_src_seeds(spark, d):
    """Seed lines written as a text file to the shared folder and read as seeds."""
    from sitesift.session import scratch_path
    from sitesift.sources.readers import read_seeds
    T(spark, d, "pages").createOrReplaceTempView("pages")
    path = scratch_path(spark, "seeds")
    spark.sql(SEED_LINES_SQL).write.text(path)
    return read_seeds(spark, path)


@query("src_pages", "SELECT page_id, url, html FROM pages")
def q_src_pages(spark, d):
    from sitesift.sources.readers import read_pages
    return read_pages(spark, f"{d.rstrip('/')}/pages.parquet")


@query("src_pages_json", "SELECT page_id, url, html FROM pages")
def q_src_pages_json(spark, d):
    """The page table written as JSON lines to the shared folder and read with a schema."""
    from sitesift.session import scratch_path
    from sitesift.sources.readers import read_pages
    path = scratch_path(spark, "pages_json")
    T(spark, d, "pages").write.json(path)
    return read_pages(spark, path, fmt="json")


@query("src_pages_csv", "SELECT page_id, url, html FROM pages")
def q_src_pages_csv(spark, d):
    """The page table written as CSV with line ends inside values, and read again."""
    from sitesift.session import scratch_path
    from sitesift.sources.readers import read_pages
    path = scratch_path(spark, "pages_csv")
    (T(spark, d, "pages").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_pages(spark, path, fmt="csv")


FETCH_LOG_SQL = """
SELECT 'http://site' || cast(user_id AS string) || '.example.com/e/' || cast(event_id AS string) AS url,
       CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status,
       CASE WHEN event_type = 'view' THEN '' ELSE props END AS html
FROM events
"""


@query("src_fetched_ok", "SELECT url, status, html FROM (" + FETCH_LOG_SQL + ") l WHERE status = 200 AND length(html) > 0")
def q_src_fetched_ok(spark, d):
    T(spark, d, "events").createOrReplaceTempView("events")
    return fetched_ok(spark.sql(FETCH_LOG_SQL))


# ================================================================ HTML on the test pages
@query("html_hrefs_raw", sql_explode("page_id, url", "regexp_extract_all(html, 'href=\"(.*?)\"', 1)", "pages", "href"))
def q_html_hrefs_raw(spark, d):
    return S.hrefs_raw(T(spark, d, "pages")).select("page_id", "url", F.col("pos").cast("int").alias("pos"), "href")


@query("html_elements", """
SELECT page_id, tag, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT page_id, lower(unnest(regexp_extract_all(
      regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '<script>', 'g'),
                     '(?s)<style[^>]*>.*?</style>', '<style>', 'g'),
      '<([A-Za-z][^\\s/>]*)', 1))) AS tag FROM pages) t
GROUP BY page_id, tag
""")
def q_html_elements(spark, d):
    e = S.element_rows(parse_pages(T(spark, d, "pages")))
    return e.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


HTML_TEXT_SQL = """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'),
    '(?s)<!--.*?-->', '', 'g'), '<![^>]*>', '', 'g'), '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', chr(169)), '&middot;', chr(183)),
  '&amp;', '&') AS text
FROM pages
"""


@query("html_text", HTML_TEXT_SQL)
def q_html_text(spark, d):
    return S.page_text(parse_pages(T(spark, d, "pages"))).select("page_id", "text")


@query("html_links", """
SELECT page_id, pos, text, href FROM (
  SELECT page_id, CAST(generate_subscripts(_a, 1) - 1 AS INTEGER) AS pos, unnest(_a) AS a FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS _a FROM pages) x) y,
  LATERAL (SELECT regexp_extract(a, '>([^<]*)<', 1) AS text, regexp_extract(a, 'href="([^"]*)"', 1) AS href)
""")
def q_html_links(spark, d):
    from pyspark.sql import Window
    ln = S.links(parse_pages(T(spark, d, "pages")))
    w = Window.partitionBy("page_id").orderBy("node_id")
    return ln.select("page_id", (F.row_number().over(w) - 1).alias("pos"), "text", "href")


# ================================================================ scalar extraction on documents
@query("x_clean_text", "SELECT doc_id, " + sql_clean("text") + " AS cleaned FROM documents")
def q_x_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


FIND_ALL_PATTERN = "[0-9]{3,}"


@query("x_find_all", sql_explode("doc_id", f"regexp_extract_all(text, '{FIND_ALL_PATTERN}')", "documents"))
def q_x_find_all(spark, d):
    return explode_matches(_docs(spark, d), "text", FIND_ALL_PATTERN).select(
        "doc_id", F.col("pos").cast("int").alias("pos"), "value")


@query("x_email", sql_explode("doc_id", f"regexp_extract_all({sql_clean('text')}, '{RE2_EMAIL}')", "documents"))
def q_x_email(spark, d):
    from sitesift.functions.text import emails_in
    return _docs(spark, d).select("doc_id", F.posexplode(emails_in(F.col("text"))).alias("pos", "value"))


@query("x_name", sql_explode("doc_id", "list_transform(regexp_extract_all(" + ASCII_US.format(c="text")
                             + f", '{RE2_NAME}', 1), lambda s: trim(s))", "documents"))
def q_x_name(spark, d):
    from sitesift.functions.text import names_in
    return _docs(spark, d).select("doc_id", F.posexplode(names_in(F.col("text"))).alias("pos", "value"))


@query("x_phone", sql_explode("doc_id", f"list_transform(regexp_extract_all({sql_clean('text')}, '{RE2_PHONE}'),"
                              " lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)))",
                              "documents"))
def q_x_phone(spark, d):
    from sitesift.functions.text import phones_in
    return _docs(spark, d).select("doc_id", F.posexplode(phones_in(F.col("text"))).alias("pos", "value"))


# documents with job titles, an e-mail that only the extractor takes and a phone that only it takes
TITLED_SQL = """
SELECT doc_id, text || (CASE doc_id % 5
    WHEN 0 THEN ' Our Project Manager met the DIRECTOR. '
    WHEN 1 THEN ' ask the vp or a sales manager '
    WHEN 2 THEN ' write to a.b@c' || cast(doc_id AS string) || '.example.co|m now '
    WHEN 3 THEN ' Phone: (212) 555-01' || lpad(cast(doc_id % 100 AS string), 2, '0') || ' now '
    ELSE '' END) AS text FROM documents
"""


def _titled(spark, d):
    T(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("documents")
    return spark.sql(TITLED_SQL)


@query("x_title_exact", sql_explode("doc_id", "regexp_extract_all(" + ASCII_US.format(c=sql_clean("text"))
                                    + f", '{re2_titles(DEFAULT_TITLES)}', 1)", "(" + TITLED_SQL + ") td"))
def q_x_title_exact(spark, d):
    from sitesift.functions.text import titles_in
    return _titled(spark, d).select("doc_id", F.posexplode(titles_in(F.col("text"), DEFAULT_TITLES)).alias("pos", "value"))


@query("x_safe_extract", """
SELECT conv_id, turn, CAST(len(regexp_extract_all(""" + sql_clean("text") + f""", '{RE2_EMAIL}')) AS INTEGER) AS n_emails,
       CAST(len(list_transform(regexp_extract_all({sql_clean('text')}, '{RE2_PHONE}'), lambda s: trim(s))) AS INTEGER) AS n_phones
FROM conversations WHERE length(text) >= 3
""")
def q_x_safe_extract(spark, d):
    from sitesift.functions.text import emails_in, long_enough, phones_in
    c = T(spark, d, "conversations")
    return c.filter(long_enough(F.col("text"))).select(
        "conv_id", "turn", F.size(emails_in(F.col("text"))).alias("n_emails"),
        F.size(phones_in(F.col("text"))).alias("n_phones"))


# ================================================================ URLs on the test pages
RFC = "^(([A-Za-z][A-Za-z0-9+.\\-]*):)?(//([^/?#]*))?([^?#]*)(\\?([^#]*))?(#(.*))?$"


def sql_url_part(c, i):
    return f"regexp_extract({c}, '{RFC}', {i})"


@query("url_parse", f"""
SELECT page_id, lower({sql_url_part('url', 2)}) AS scheme, {sql_url_part('url', 4)} AS netloc,
       {sql_url_part('url', 5)} AS path, {sql_url_part('url', 7)} AS query, {sql_url_part('url', 9)} AS fragment
FROM pages WHERE {sql_url_part('url', 4)} <> ''
""")
def q_url_parse(spark, d):
    from sitesift.operators.links import parse_urls
    return parse_urls(T(spark, d, "pages")).select("page_id", "scheme", "netloc", "path", "query", "fragment")


def sql_norm(c):
    low = f"lower({c})"
    return (f"(CASE WHEN {sql_url_part(low, 4)} <> '' THEN 'http://' || {sql_url_part(low, 4)} || "
            f"regexp_replace({sql_url_part(low, 5)}, ';[^/]*$', '') END)")


@query("url_normalize", f"SELECT DISTINCT {sql_norm('url')} AS norm_url FROM pages WHERE {sql_norm('url')} IS NOT NULL")
def q_url_normalize(spark, d):
    return T(spark, d, "pages").select(normalize_url(F.col("url")).alias("norm_url")) \
        .filter(F.col("norm_url").isNotNull()).distinct()


HREFS_SQL = sql_explode("page_id, url", "regexp_extract_all(html, 'href=\"(.*?)\"', 1)", "pages", "href")
# root-relative hrefs resolve to scheme://netloc + href (the test pages hold no other kind)
SQL_JOIN_ROOTREL = ("(CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//') THEN "
                    f"lower({sql_url_part('url', 2)}) || '://' || {sql_url_part('url', 4)} || href "
                    "ELSE NULL END)")


@query("url_join", f"SELECT page_id, pos, href, {SQL_JOIN_ROOTREL} AS abs_url FROM ({HREFS_SQL}) h")
def q_url_join(spark, d):
    h = q_html_hrefs_raw(spark, d)
    return with_joined_url(h, "url", "href", "abs_url").select("page_id", "pos", "href", "abs_url")


# one href of each kind; the wanted URL is what urljoin gives for the page's host
JOIN_HREFS = ["c", "/c", "../c", "./c", "?z=2", "#t", "", "//o.example.com/p", "https://o.example.com", "a/../d",
              "../../../e", "mailto:x@y.z", "tel:1", "c/./d/", "c/..", "/x/../../y", "g;p?q#f", "..", ".", " /c",
              "\n/c\n", "/c\t/d", "//", "///x", "  ", ";p", "..;p", ";", "a//b", "/a//b", "http:", "http:a", " mailto:x"]
JOIN_BASE = "http://h@@.example.com/a/b;x?q=1#f"


def _join_cases_sql():
    from urllib.parse import urljoin

    quote = lambda v: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    rows = ", ".join(f"({i}, {quote(h)}, {quote(urljoin(JOIN_BASE, h))})" for i, h in enumerate(JOIN_HREFS))
    return f"(VALUES {rows}) AS jc(k, href, want)"


@query("url_join_cases", f"""
SELECT p.page_id, jc.k, jc.href, replace(jc.want, '@@', cast(p.page_id AS string)) AS abs_url FROM pages p, {_join_cases_sql()}
""")
def q_url_join_cases(spark, d):
    base = T(spark, d, "pages").select("page_id", F.replace(F.lit(JOIN_BASE), F.lit("@@"), F.col("page_id").cast("string")).alias("base"))
    cases = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(h).alias("href")) for i, h in enumerate(JOIN_HREFS)])
    rows = base.select("page_id", "base", F.explode(cases).alias("c")).select("page_id", "base", "c.k", "c.href")
    return with_joined_url(rows, "base", "href", "abs_url").select("page_id", "k", "href", "abs_url")


FILTER_SUFFIXES = ["", ".html", ".css", ".css?v=1", ".pdf", ".PDF", ".js", ".jsonx"]


@query("url_filter", f"""
SELECT page_id, pos, abs_url || x.suffix AS abs_url,
       NOT (regexp_matches(abs_url || x.suffix, '\\.(json|css|png|jpg|svg|ico|js|gif|pdf|xml)$')
            OR starts_with(abs_url || x.suffix, 'mailto')) AS is_html
FROM (SELECT page_id, pos, {SQL_JOIN_ROOTREL} AS abs_url FROM ({HREFS_SQL}) h) j,
     (VALUES {", ".join(f"('{x}')" for x in FILTER_SUFFIXES)}) AS x(suffix)
""")
def q_url_filter(spark, d):
    j = q_url_join(spark, d).withColumn("s", F.explode(F.array(*map(F.lit, FILTER_SUFFIXES))))
    j = j.withColumn("abs_url", F.concat("abs_url", "s"))
    return j.select("page_id", "pos", "abs_url", is_html_url(F.col("abs_url")).alias("is_html"))


UNIQUE_LINKS_SQL = f"""
SELECT page_id, url, norm_url, min(pos) AS pos FROM (
  SELECT page_id, url, pos, abs_url, {sql_norm('abs_url')} AS norm_url FROM (
    SELECT page_id, url, pos, href, {SQL_JOIN_ROOTREL} AS abs_url FROM ({HREFS_SQL}) h) j
  WHERE NOT (regexp_matches(abs_url, '\\.(json|css|png|jpg|svg|ico|js|gif|pdf|xml)$') OR starts_with(abs_url, 'mailto'))
) k WHERE norm_url IS NOT NULL GROUP BY page_id, url, norm_url
"""


@query("url_links_unique", UNIQUE_LINKS_SQL)
def q_url_links_unique(spark, d):
    from sitesift.operators.links import unique_links
    return unique_links(T(spark, d, "pages")).select("page_id", "url", "norm_url", F.col("pos").cast("int").alias("pos"))


@query("url_link_graph", f"""
WITH e AS (SELECT DISTINCT {sql_norm('url')} AS src, norm_url AS dst FROM ({UNIQUE_LINKS_SQL}) u),
     pg AS (SELECT DISTINCT {sql_norm('url')} AS node FROM pages WHERE {sql_norm('url')} IS NOT NULL),
     o AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY src),
     i AS (SELECT dst AS node, count(*) AS in_degree FROM e GROUP BY dst),
     n AS (SELECT node FROM pg UNION SELECT node FROM o UNION SELECT node FROM i)
SELECT n.node, CAST(coalesce(o.out_degree, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.in_degree, 0) AS BIGINT) AS in_degree,
       CASE WHEN pg.node IS NULL THEN 0 ELSE 1 END AS is_page
FROM n LEFT JOIN o ON n.node = o.node LEFT JOIN i ON n.node = i.node LEFT JOIN pg ON n.node = pg.node
""")
def q_url_link_graph(spark, d):
    from sitesift.operators.links import link_graph
    return link_graph(T(spark, d, "pages"))


# ================================================================ HTML on generated contact pages
from sitesift.plans.generated import CONTACT_HTML_SQL, contact_pages  # noqa: E402

GEN = "(" + CONTACT_HTML_SQL + ") g"


def _cparsed(spark, d):
    return parse_pages(contact_pages(spark, d))


@query("html_meta", f"SELECT page_id, 'Ask ' || person || ', ' || title AS content FROM {GEN}")
def q_html_meta(spark, d):
    return S.meta_contents(_cparsed(spark, d)).select("page_id", "content")


@query("html_mailto", f"SELECT page_id, email || '?subject=hi' AS value FROM {GEN}")
def q_html_mailto(spark, d):
    return S.mailto(_cparsed(spark, d)).select("page_id", "value")


@query("html_contact_elements", f"SELECT page_id, 'Call ' || phone AS text FROM {GEN}")
def q_html_contact_elements(spark, d):
    return S.contact_elements(_cparsed(spark, d)).select("page_id", "text")


TEAM_TEXT = "person || ' - ' || title || ' . Mail ' || email || ' . Tel ' || phone"


@query("html_context_blocks", f"SELECT page_id, 'team' AS keyword, 'high' AS weight, 'id' AS via, {TEAM_TEXT} AS text FROM {GEN}")
def q_html_context_blocks(spark, d):
    return S.context_blocks(_cparsed(spark, d)).select("page_id", "keyword", "weight", "via", "text")


CTX_CLASSES = ["Staff-directory", "x company", "group", "plain", "MEMBERS crew"]
CTX_VALUES = ", ".join(f"('{k}', '{w}')" for w, ks in CONTEXT_KEYWORDS.items() for k in ks)
CTX_CASE = "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CTX_CLASSES)) + " END"


@query("html_context_weights", f"""
SELECT c_custkey AS page_id, kw.keyword, kw.weight, a.via, 'T' || cast(c_custkey AS string) AS text
FROM customer, (VALUES ('class'), ('id')) AS a(via), (VALUES {CTX_VALUES}) AS kw(keyword, weight)
WHERE contains(lower(CASE WHEN a.via = 'class' THEN {CTX_CASE} ELSE 'unit-' || c_mktsegment END), kw.keyword)
""")
def q_html_context_weights(spark, d):
    T(spark, d, "customer").createOrReplaceTempView("customer")
    pages = spark.sql(f"""SELECT c_custkey AS page_id, 'http://x' AS url, '<div class="' || {CTX_CASE} || '" id="unit-' ||
                          c_mktsegment || '">T' || cast(c_custkey AS string) || '</div>' AS html FROM customer""")
    return S.context_blocks(parse_pages(pages)).select("page_id", "keyword", "weight", "via", "text")


@query("html_header_siblings", f"SELECT page_id, 'high' AS weight, cname || ' ' || title AS text FROM {GEN}")
def q_html_header_siblings(spark, d):
    return S.header_siblings(_cparsed(spark, d)).select("page_id", "weight", "text")


VCARD_SQL = f"""
SELECT page_id, url, 'name' AS type, person AS value FROM {GEN} UNION ALL
SELECT page_id, url, 'organization', 'Org ' || nname FROM {GEN} UNION ALL
SELECT page_id, url, 'email', email FROM {GEN} UNION ALL
SELECT page_id, url, 'phone', phone FROM {GEN}
"""


@query("html_vcard", VCARD_SQL)
def q_html_vcard(spark, d):
    return S.vcards(_cparsed(spark, d)).select("page_id", "url", "type", "value")


JSONLD_SQL = f"""
SELECT page_id, url, 'name' AS type, 'Org ' || nname AS value FROM {GEN} WHERE seg = 'BUILDING' UNION ALL
SELECT page_id, url, 'phone', phone FROM {GEN} WHERE seg = 'BUILDING' UNION ALL
SELECT page_id, url, 'name', person FROM {GEN} WHERE seg = 'AUTOMOBILE' UNION ALL
SELECT page_id, url, 'title', title FROM {GEN} WHERE seg = 'AUTOMOBILE' UNION ALL
SELECT page_id, url, 'email', email FROM {GEN} WHERE seg IN ('AUTOMOBILE', 'HOUSEHOLD')
"""


@query("html_jsonld", JSONLD_SQL)
def q_html_jsonld(spark, d):
    return S.jsonld(_cparsed(spark, d)).select("page_id", "url", "type", "value")


GEN_NODES = ("[cname, person, '.', 'Org ' || nname, '.', email, '.', phone, '.', person || ' - ' || title, '.', "
             "'Mail ' || email, '.', 'Tel ' || phone, '.', 'Our People', cname || ' ' || title, '.', 'Call ' || phone, "
             "'.', 'Write to ' || person, '.', 'Profile']")
GEN_NODES_SQL = sql_explode("page_id, url", GEN_NODES, GEN, "text")


@query("html_text_nodes", GEN_NODES_SQL)
def q_html_text_nodes(spark, d):
    return S.text_nodes(_cparsed(spark, d)).select("page_id", "url", "pos", "text")


@query("x_linkedin", f"SELECT page_id, 'https://www.linkedin.com/in/c' || cast(page_id AS string) AS value FROM {GEN}")
def q_x_linkedin(spark, d):
    from sitesift.operators.validate import validate_linkedin
    ln = S.links(_cparsed(spark, d))
    return ln.filter(validate_linkedin(F.col("href")).isNotNull()).select("page_id", F.col("href").alias("value"))


RE2_W_NAME = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"
RE2_W_PHONE = r"\b(?:\+\d{1,2}\s?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}\b"


def sql_wrapper_mentions(src, text="text", ids="page_id, url"):
    kws = sql_list([k.lower() for k in WRAPPER_TITLES])
    return f"""
SELECT {ids}, 'email' AS type, unnest(regexp_extract_all({text}, '{RE2_EMAIL}')) AS value FROM {src} UNION ALL
SELECT {ids}, 'name', unnest(regexp_extract_all({text}, '{RE2_W_NAME}')) FROM {src} UNION ALL
SELECT {ids}, 'phone', unnest(regexp_extract_all({text}, '{RE2_W_PHONE}')) FROM {src} UNION ALL
SELECT {ids}, 'title', {text} FROM {src} WHERE len(list_filter({kws}, lambda k: contains(lower({text}), k))) > 0
"""


@query("x_wrapper_text", sql_wrapper_mentions("(" + GEN_NODES_SQL + ") n", ids="page_id, url, pos"))
def q_x_wrapper_text(spark, d):
    from sitesift.operators.extract import wrapper_text_mentions
    return wrapper_text_mentions(S.text_nodes(_cparsed(spark, d)), ids=("page_id", "url", "pos")) \
        .select("page_id", "url", "pos", "type", "value")


WRAPPER_ALL_SQL = f"""
SELECT DISTINCT page_id, url, type, value FROM (
{sql_wrapper_mentions("(" + GEN_NODES_SQL + ") n")} UNION ALL
{sql_wrapper_mentions("(SELECT page_id, url, 'Ask ' || person || ', ' || title AS text FROM " + GEN + ") m")} UNION ALL
{sql_wrapper_mentions("(SELECT page_id, url, 'Call ' || phone AS text FROM " + GEN + ") c")} UNION ALL
SELECT page_id, url, 'email', email || '?subject=hi' FROM {GEN}) a
"""


@query("pipe_wrapper", f"""
SELECT page_id, url, type, value, relevance,
       CAST(row_number() OVER (PARTITION BY page_id, url ORDER BY relevance DESC, value, type) AS INTEGER) AS rn
FROM (SELECT *, CASE type WHEN 'email' THEN 5 WHEN 'name' THEN 4 WHEN 'phone' THEN 3 WHEN 'title' THEN 2 ELSE 1 END
             AS relevance FROM ({WRAPPER_ALL_SQL}) w) r
""")
def q_pipe_wrapper(spark, d):
    from sitesift.plans.contact import wrapper_info
    return wrapper_info(contact_pages(spark, d)).select("page_id", "url", "type", "value", "relevance", "rn")


# ================================================================ aggregation over document mentions
def _doc_mentions(spark, d, types=("email", "name", "phone", "title")):
    """Mentions of every titled document, with url = 'doc://<id>'."""
    docs = _titled(spark, d).select(F.col("doc_id").alias("page_id"),
                                           F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), "text")
    return text_mentions(docs, "text", origin="text", types=types, titles=DEFAULT_TITLES, min_len=3)


def sql_doc_mentions(src):
    return f"""
SELECT doc_id AS page_id, 'doc://' || cast(doc_id AS string) AS url, 'email' AS type,
       unnest(regexp_extract_all({sql_clean('text')}, '{RE2_EMAIL}')) AS value FROM {src} WHERE length(text) >= 3
UNION ALL
SELECT doc_id, 'doc://' || cast(doc_id AS string), 'name',
       trim(unnest(regexp_extract_all({ASCII_US.format(c='text')}, '{RE2_NAME}', 1))) FROM {src} WHERE length(text) >= 3
UNION ALL
SELECT doc_id, 'doc://' || cast(doc_id AS string), 'phone',
       trim(unnest(regexp_extract_all({sql_clean('text')}, '{RE2_PHONE}')), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))
       FROM {src} WHERE length(text) >= 3
UNION ALL
SELECT doc_id, 'doc://' || cast(doc_id AS string), 'title',
       unnest(regexp_extract_all({ASCII_US.format(c=sql_clean('text'))}, '{re2_titles(DEFAULT_TITLES)}', 1))
       FROM {src} WHERE length(text) >= 3
"""


DOC_MENTIONS_SQL = sql_doc_mentions("(" + TITLED_SQL + ") td")


@query("agg_distinct_mentions", f"SELECT DISTINCT page_id, url, type, value FROM ({DOC_MENTIONS_SQL}) m "
                                "WHERE value IS NOT NULL AND value <> 'not_found'")
def q_agg_distinct_mentions(spark, d):
    from sitesift.operators.aggregate import distinct_mentions
    return distinct_mentions(_doc_mentions(spark, d))


@query("agg_global_dedup", f"""
SELECT type, norm_value, min(url) AS first_url, count(DISTINCT url) AS n_pages FROM (
  SELECT type, url, CASE WHEN type = 'email' THEN lower(trim(value)) ELSE trim(value) END AS norm_value
  FROM ({DOC_MENTIONS_SQL}) m) t GROUP BY type, norm_value
""")
def q_agg_global_dedup(spark, d):
    from sitesift.operators.aggregate import global_dedup
    return global_dedup(_doc_mentions(spark, d))


@query("agg_type_counts", f"""
SELECT netloc, url, count(*) AS n_mentions,
       count(*) FILTER (WHERE type = 'email') AS n_email, count(*) FILTER (WHERE type = 'name') AS n_name,
       count(*) FILTER (WHERE type = 'linkedin') AS n_linkedin, count(*) FILTER (WHERE type = 'title') AS n_title,
       count(*) FILTER (WHERE type = 'phone') AS n_phone, count(*) FILTER (WHERE type = 'organization') AS n_organization
FROM (SELECT *, {sql_url_part('url', 4)} AS netloc FROM ({DOC_MENTIONS_SQL}) m) t
GROUP BY ROLLUP (netloc, url)
""")
def q_agg_type_counts(spark, d):
    from sitesift.operators.aggregate import type_counts
    return type_counts(_doc_mentions(spark, d))


@query("agg_contact_record", f"""
SELECT CASE WHEN type = 'email' THEN value END AS email, CASE WHEN type = 'name' THEN value END AS name,
       CASE WHEN type = 'linkedin' THEN value END AS linkedin, CASE WHEN type = 'title' THEN value END AS title,
       CASE WHEN type = 'phone' THEN value END AS phone, CASE WHEN type = 'organization' THEN value END AS organization,
       url AS src_url
FROM ({DOC_MENTIONS_SQL}) m
""")
def q_agg_contact_record(spark, d):
    from sitesift.operators.aggregate import sparse_records
    return sparse_records(_doc_mentions(spark, d))


@query("sort_relevance", f"""
SELECT url, type, value, relevance,
       CAST(row_number() OVER (PARTITION BY url ORDER BY relevance DESC, value, type) AS INTEGER) AS rn
FROM (SELECT DISTINCT url, type, value,
             CASE type WHEN 'email' THEN 5 WHEN 'name' THEN 4 WHEN 'phone' THEN 3 WHEN 'title' THEN 2 ELSE 1 END AS relevance
      FROM ({DOC_MENTIONS_SQL}) m) t
""")
def q_sort_relevance(spark, d):
    from sitesift.operators.aggregate import sort_by_relevance
    return sort_by_relevance(_doc_mentions(spark, d))


# ================================================================ validation
V_EMAIL_RE2 = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
V_PHONE_RE2 = r"^\+?[\d\s.-]+\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$"


@query("v_email", f"""
SELECT page_id, value, CASE WHEN regexp_matches(value, '{V_EMAIL_RE2}') THEN value END AS valid
FROM ({DOC_MENTIONS_SQL}) m WHERE type = 'email'
""")
def q_v_email(spark, d):
    from sitesift.operators.validate import validate_email
    m = _doc_mentions(spark, d, ("email",))
    return m.select("page_id", "value", validate_email(F.col("value")).alias("valid"))


@query("v_phone", f"""
SELECT page_id, value, CASE WHEN regexp_matches(value, '{V_PHONE_RE2}') THEN value END AS valid
FROM ({DOC_MENTIONS_SQL}) m WHERE type = 'phone'
""")
def q_v_phone(spark, d):
    from sitesift.operators.validate import validate_phone
    m = _doc_mentions(spark, d, ("phone",))
    return m.select("page_id", "value", validate_phone(F.col("value")).alias("valid"))


@query("v_linkedin", f"""
SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://(?:www\\.)?linkedin\\.com/in/[\\w\\-]+/?$') THEN href END AS valid
FROM (SELECT page_id, 'https://www.linkedin.com/in/c' || cast(page_id AS string) AS href FROM {GEN}
      UNION ALL SELECT page_id, 'mailto:' || email || '?subject=hi' FROM {GEN}) l
""")
def q_v_linkedin(spark, d):
    from sitesift.operators.validate import validate_linkedin
    ln = S.links(_cparsed(spark, d))
    return ln.select("page_id", "href", validate_linkedin(F.col("href")).alias("valid"))


@query("v_name", f"""
SELECT page_id, value, CASE WHEN regexp_matches(value, '^[A-Z][a-z]+(?: [A-Z][a-z]+){{1,3}}$')
       AND len(list_filter(string_split(lower(value), ' '), lambda w: list_contains({sql_list([k.lower() for k in DEFAULT_TITLES])}, w))) = 0
       THEN value END AS valid
FROM ({DOC_MENTIONS_SQL}) m WHERE type = 'name'
""")
def q_v_name(spark, d):
    from sitesift.operators.validate import validate_name_rule
    m = _doc_mentions(spark, d, ("name",))
    return m.select("page_id", "value", validate_name_rule(F.col("value"), DEFAULT_TITLES).alias("valid"))


# ================================================================ crawl (generated link trees, test pages, events)
from sitesift.plans.generated import LINK_HTML_SQL, link_pages, link_seeds, register_views  # noqa: E402

LGEN = "(" + LINK_HTML_SQL + ") lg"


def sql_netloc(c):
    return sql_url_part(c, 4)


def sql_anchor_links(src):
    """(page_id, src_url, pos, href, text, dst_url) from '<a href="..">text</a>' anchors; hrefs that
    are root-relative are resolved against the page URL, others kept (test generators only use those)."""
    return f"""
SELECT page_id, src_url, pos, href, text,
       CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//')
            THEN lower({sql_url_part('src_url', 2)}) || '://' || {sql_netloc('src_url')} || href ELSE href END AS dst_url
FROM (SELECT page_id, src_url, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS text
      FROM (SELECT page_id, url AS src_url, CAST(generate_subscripts(_a, 1) - 1 AS INTEGER) AS pos, unnest(_a) AS a
            FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS _a FROM {src}) x) y) z
"""


def sql_score(url, text):
    kws = sql_list(URL_KEYWORDS)
    path = f"lower(regexp_replace({sql_url_part(url, 5)}, ';[^/]*$', ''))"
    return (f"((CASE WHEN len(list_filter({kws}, lambda k: contains({path}, k))) > 0 THEN 5 ELSE 0 END)"
            f" + (CASE WHEN len(list_filter({kws}, lambda k: contains(lower({text}), k))) > 0 THEN 3 ELSE 0 END)"
            f" + greatest(0, 3 - (length({path}) - length(replace({path}, '/', '')))))")


LINKS_SCORED_SQL = f"SELECT *, CAST({sql_score('dst_url', 'text')} AS INTEGER) AS score FROM ({sql_anchor_links(LGEN)}) a"


def _link_edges_all(spark, d):
    from pyspark.sql import Window
    from sitesift.operators.crawl import with_relevance
    from sitesift.functions.urls import with_joined_url
    ln = S.links(parse_pages(link_pages(spark, d)))
    w = Window.partitionBy("page_id").orderBy("node_id")
    ln = ln.withColumn("pos", F.row_number().over(w) - 1)
    ln = with_relevance(with_joined_url(ln, "url", "href", "dst_url"), "dst_url", "text", "score")
    return ln.select("page_id", F.col("url").alias("src_url"), "pos", "href", "text", "dst_url", "score")


@query("crawl_relevance", f"SELECT page_id, pos, dst_url, text, score FROM ({LINKS_SCORED_SQL}) s")
def q_crawl_relevance(spark, d):
    return _link_edges_all(spark, d).select("page_id", "pos", "dst_url", "text", "score")


@query("crawl_enqueue", f"""
SELECT src_url, dst_url, min(100 - score) AS priority, 1 AS depth FROM ({LINKS_SCORED_SQL}) s
WHERE score > 0 AND {sql_netloc('dst_url')} = {sql_netloc('src_url')} GROUP BY src_url, dst_url
""")
def q_crawl_enqueue(spark, d):
    from sitesift.operators.crawl import crawl_edges
    e = crawl_edges(link_pages(spark, d))
    return e.select("src_url", "dst_url", "priority", F.lit(1).alias("depth"))


@query("crawl_same_site", f"""
SELECT DISTINCT src_url, dst_url FROM ({LINKS_SCORED_SQL}) s
WHERE {sql_netloc('dst_url')} = {sql_netloc('src_url')}
  AND dst_url NOT IN (SELECT url FROM {LGEN} WHERE n = 0)
""")
def q_crawl_same_site(spark, d):
    from sitesift.operators.crawl import same_site_unseen
    e = _link_edges_all(spark, d)
    visited = link_seeds(spark, d).select(F.col("seed").alias("url"))
    return same_site_unseen(e, visited).select("src_url", "dst_url")


BFS_SQL = f"""
WITH RECURSIVE
e AS (SELECT src_url AS src, dst_url AS dst, 100 - score AS prio FROM ({LINKS_SCORED_SQL}) s
      WHERE score > 0 AND {sql_netloc('dst_url')} = {sql_netloc('src_url')}),
seeds AS (SELECT url AS seed FROM {LGEN} WHERE n = 0),
walk(seed, url, depth) AS (
  SELECT seed, seed, 0 FROM seeds
  UNION
  SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.url
  WHERE w.depth < 3 AND {sql_netloc('e.dst')} = {sql_netloc('w.seed')}),
dist AS (SELECT seed, url, min(depth) AS depth FROM walk GROUP BY seed, url)
SELECT v.seed, v.url, v.depth,
       CASE WHEN v.depth = 0 THEN 0 ELSE
         (SELECT min(e.prio) FROM e JOIN dist p ON p.url = e.src AND p.seed = v.seed AND p.depth = v.depth - 1
          WHERE e.dst = v.url) END AS priority
FROM dist v
"""


def _bfs(spark, d):
    from sitesift.operators.crawl import crawl_bfs, crawl_edges
    return crawl_bfs(link_seeds(spark, d), crawl_edges(link_pages(spark, d)), max_depth=3)


@query("crawl_bfs", BFS_SQL)
def q_crawl_bfs(spark, d):
    return _bfs(spark, d).select("seed", "url", "depth", "priority")


BUDGET = 8


@query("crawl_budget", f"""
SELECT seed, url, depth, priority, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY depth, priority, url) AS INTEGER) AS rank FROM ({BFS_SQL}) b) r
WHERE rank <= {BUDGET}
""")
def q_crawl_budget(spark, d):
    from sitesift.operators.crawl import crawl_budget
    return crawl_budget(_bfs(spark, d), BUDGET).select("seed", "url", "depth", "priority", "rank")


@query("crawl_visited_dedup", f"SELECT DISTINCT {sql_norm('url')} AS norm_url FROM pages WHERE {sql_norm('url')} IS NOT NULL")
def q_crawl_visited_dedup(spark, d):
    from sitesift.operators.crawl import visited_dedup
    return visited_dedup(T(spark, d, "pages")).select("norm_url")


@query("crawl_slots", f"""
WITH r AS (SELECT url, {sql_netloc('url')} AS netloc,
                  row_number() OVER (PARTITION BY {sql_netloc('url')} ORDER BY url) AS dom_rank FROM pages),
l AS (SELECT *, CAST(floor((dom_rank - 1) / 5) AS BIGINT) AS level FROM r),
c AS (SELECT level, CAST(ceil(count(*) / 10) AS BIGINT) AS secs FROM l GROUP BY level),
s AS (SELECT level, CAST(coalesce(sum(secs) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY netloc, url) AS level_rank FROM l)
SELECT k.url, k.netloc, CAST(k.dom_rank AS BIGINT) AS dom_rank, k.level,
       CAST(s.start + floor((k.level_rank - 1) / 10) AS BIGINT) AS slot
FROM k JOIN s ON k.level = s.level
""")
def q_crawl_slots(spark, d):
    from sitesift.operators.crawl import fetch_slots
    return fetch_slots(T(spark, d, "pages").select("url"))


@query("crawl_rate_audit", """
SELECT user_id AS domain, CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS window_start,
       CAST(epoch(time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day') AS BIGINT) AS window_end, count(*) AS n
FROM events GROUP BY 1, 2, 3 HAVING count(*) > 3
""")
def q_crawl_rate_audit(spark, d):
    from sitesift.operators.crawl import rate_audit
    return rate_audit(T(spark, d, "events"), "ts", "user_id", "1 day", 3)


# ================================================================ fuzzy titles
def sql_dict(keywords):
    from sitesift.functions.fuzzy import _process_py
    rows = ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', {i}, '{_process_py(k)}')" for i, k in enumerate(keywords))
    return f"(VALUES {rows}) AS kd(kw, ord, kp)"


def sql_fuzzy(texts, ids, keywords, k=5, min_score=30):
    """Top-k keywords per text by the tiered score; texts: subquery with columns ids + text.
    Windows are built with lead() over the word positions (linear in the text)."""
    cleaned = sql_clean("text")
    return f"""
WITH tx AS (SELECT {ids}, {cleaned} AS ct FROM {texts}),
wd AS (SELECT {ids}, w, i FROM (SELECT {ids}, unnest(list_filter(string_split(ct, ' '), lambda x: x <> '')) AS w,
                                    unnest(range(0, len(list_filter(string_split(ct, ' '), lambda x: x <> '')))) AS i FROM tx) u),
win AS (SELECT {ids}, i, w || ' ' || lead(w, 1) OVER (PARTITION BY {ids} ORDER BY i) || ' ' ||
               lead(w, 2) OVER (PARTITION BY {ids} ORDER BY i) AS win,
               lead(w, 3) OVER (PARTITION BY {ids} ORDER BY i) AS w3 FROM wd),
qs AS (SELECT {ids}, trim(regexp_replace(lower(string_agg(win, ' ' ORDER BY i)), '[^a-z0-9]', ' ', 'g')) AS qp
       FROM win WHERE w3 IS NOT NULL GROUP BY {ids}),
q AS (SELECT {ids}, qp, string_split_regex(qp, ' +') AS qw FROM qs),
sc AS (SELECT {ids}, kw, ord,
      CASE WHEN length(kp) = 0 OR length(qp) = 0 THEN 0
           WHEN contains(qp, kp) THEN 60
           WHEN len(list_intersect(string_split_regex(kp, ' +'), qw)) > 0 THEN 57
           ELSE least(56, CAST(round(100.0 * (1.0 - levenshtein(kp, qp) / greatest(length(kp), length(qp)))) AS INTEGER))
      END AS score
    FROM q CROSS JOIN {sql_dict(keywords)})
SELECT {ids}, kw AS value, score, CAST(rk AS INTEGER) AS rk FROM (
  SELECT {ids}, kw, score, row_number() OVER (PARTITION BY {ids} ORDER BY score DESC, ord) AS rk
  FROM sc WHERE score > {min_score}) r
WHERE rk <= {k}
"""


@query("x_title_fuzzy", "SELECT doc_id, value, rk FROM (" + sql_fuzzy("documents", "doc_id", DEFAULT_TITLES) + ") f")
def q_x_title_fuzzy(spark, d):
    from sitesift.functions.fuzzy import fuzzy_titles_of, with_fuzzy_query
    docs = with_fuzzy_query(_docs(spark, d), F.col("text"))
    return docs.select("doc_id", F.posexplode(fuzzy_titles_of(DEFAULT_TITLES)).alias("rk", "value")) \
        .select("doc_id", "value", (F.col("rk") + 1).alias("rk"))


SHORT_SQL = "SELECT c_custkey AS doc_id, c_name || ' works in ' || c_mktsegment || ' since ' || cast(c_nationkey AS string) AS text FROM customer"


@query("x_title_fuzzy_low", "SELECT doc_id, value, rk FROM (" + sql_fuzzy("(" + SHORT_SQL + ") st", "doc_id", DEFAULT_TITLES, 8, 10) + ") f")
def q_x_title_fuzzy_low(spark, d):
    """Fuzzy titles with a low cut-off, where keywords of very different length still score."""
    from sitesift.functions.fuzzy import fuzzy_titles_of, with_fuzzy_query
    T(spark, d, "customer").createOrReplaceTempView("customer")
    docs = with_fuzzy_query(spark.sql(SHORT_SQL), F.col("text"))
    return docs.select("doc_id", F.posexplode(fuzzy_titles_of(DEFAULT_TITLES, 8, 10)).alias("rk", "value")) \
        .select("doc_id", "value", (F.col("rk") + 1).alias("rk"))


# pairs of customers of one market segment within blocks of 64 keys: at most 64 partners each
PAIRS_SQL = """
SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_name || ' ' || cast(cast(floor(a.c_acctbal * 100) AS bigint) AS string) AS an,
       b.c_name || ' ' || cast(cast(floor(b.c_acctbal * 100) AS bigint) AS string) AS bn
FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND floor(a.c_custkey / 64) = floor(b.c_custkey / 64)
                                   AND a.c_custkey < b.c_custkey
"""


@query("x_ratio_exact", f"""
WITH RECURSIVE p AS ({PAIRS_SQL}),
w AS (SELECT a, b, 0 AS side, CAST(0 AS BIGINT) AS n, lower(an) AS x, lower(bn) AS y FROM p
      UNION ALL
      SELECT a, b, s.side, m.n, CASE s.side WHEN 0 THEN substr(x, 1, m.i - 1) ELSE substr(x, m.i + m.n) END,
             CASE s.side WHEN 0 THEN substr(y, 1, m.j - 1) ELSE substr(y, m.j + m.n) END
      FROM (SELECT a, b, x, y, list_max(list_transform(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i:
                     list_transform(range(1, length(x) - i + 2), lambda n: {{'n': n, 'i': -i, 'j': -instr(y, substr(x, i, n))}}))),
                     lambda t: t.j < 0), lambda t: t)) AS best FROM w WHERE x <> '' AND y <> '') v,
           LATERAL (SELECT {{'n': best.n, 'i': -best.i, 'j': -best.j}} AS m) k, (VALUES (0), (1)) AS s(side)
      WHERE best IS NOT NULL),
t AS (SELECT a, b, sum(n) AS m FROM w WHERE side = 0 GROUP BY 1, 2)
SELECT p.a, p.b, CAST(round_even(100 * (CAST(2 * t.m AS DOUBLE) / (length(an) + length(bn))), 0) AS INTEGER) AS ratio FROM p JOIN t USING (a, b)
""")
def q_x_ratio_exact(spark, d):
    """Exact 2*M/T ratio of customers' names and balances, pairs of one segment and block."""
    from sitesift.functions.similarity import ratio_udf
    T(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql(PAIRS_SQL).select("a", "b", ratio_udf("an", "bn").alias("ratio"))


@query("x_title_score")
def q_x_title_score(spark, d):
    """Full title score of customers, pairs of one segment and block, and of every part name
    against the customer of its number; edit distance to substrings has no SQL form: the score
    is held against a plain version in tests/."""
    from sitesift.functions.similarity import title_score_udf
    for t in ("customer", "part"):
        T(spark, d, t).createOrReplaceTempView(t)
    pairs = spark.sql(f"""SELECT a, b, an, bn FROM ({PAIRS_SQL}) p UNION ALL
        SELECT c_custkey, -1 - p_partkey, c_name || ' ' || c_mktsegment || ' ' || p_type || ' ' || p_name || ' ' || p_brand, p_name
        FROM customer JOIN part ON c_custkey = p_partkey""")
    return pairs.select("a", "b", title_score_udf("an", "bn").alias("score"))


@query("x_fuzzy_match", """
SELECT c_custkey, s_name, c_name, r AS ratio, r >= 50 AS is_match FROM (
  SELECT c_custkey, s_name, c_name,
         CASE WHEN greatest(length(c_name), length(s_name)) = 0 THEN 0 ELSE
         CAST(round(100.0 * (1.0 - levenshtein(lower(c_name), lower(s_name)) / greatest(length(c_name), length(s_name)))) AS INTEGER) END AS r
  FROM customer JOIN supplier ON c_custkey = s_suppkey) t
""")
def q_x_fuzzy_match(spark, d):
    from sitesift.functions.fuzzy import levenshtein_ratio
    c, s = T(spark, d, "customer"), T(spark, d, "supplier")
    j = c.join(s, c.c_custkey == s.s_suppkey).select("c_custkey", "s_name", "c_name",
                                                      levenshtein_ratio(F.col("c_name"), F.col("s_name")).alias("ratio"))
    return j.withColumn("is_match", F.col("ratio") >= 50)


# ================================================================ profile "contextual" on generated pages (Q1)
PAGE_TEXT = ("cname || person || ' . Org ' || nname || ' . ' || email || ' . ' || phone || ' . ' || "
             + TEAM_TEXT + " || ' . Our People' || cname || ' ' || title || ' . Call ' || phone || ' . Write to ' || "
             "person || ' . Profile'")


def sql_text_mentions(src, types, fuzzy=True, min_len=3, titles=DEFAULT_TITLES):
    """Mentions of a text subquery (page_id, url, text[, tid]) in SQL."""
    where = f" WHERE length(text) >= {min_len}" if min_len else ""
    s = f"(SELECT * FROM {src}{where})"
    parts = []
    if "email" in types:
        parts.append(f"SELECT page_id, url, 'email' AS type, unnest(regexp_extract_all({sql_clean('text')}, '{RE2_EMAIL}')) AS value FROM {s} e")
    if "name" in types:
        parts.append(f"SELECT page_id, url, 'name', trim(unnest(regexp_extract_all({ASCII_US.format(c='text')}, '{RE2_NAME}', 1))) FROM {s} n")
    if "phone" in types:
        parts.append(f"SELECT page_id, url, 'phone', trim(unnest(regexp_extract_all({sql_clean('text')}, '{RE2_PHONE}'))) FROM {s} p")
    if "title" in types:
        parts.append(f"SELECT page_id, url, 'title', unnest(regexp_extract_all({ASCII_US.format(c=sql_clean('text'))}, "
                     f"'{re2_titles(titles)}', 1)) FROM {s} t")
        if fuzzy:
            parts.append(f"SELECT page_id, url, 'title', value FROM ({sql_fuzzy(s, 'page_id, url, tid', titles)}) f")
    return " UNION ALL ".join(parts)


def _texts(expr, tid="0"):
    return f"(SELECT page_id, url, {expr} AS text, {tid} AS tid FROM {GEN})"


# (confidence, SQL) per source of mentions: context blocks 0.5 x 1.2 (weight high), mailto 1.0, others 0.5
CONTACT_PARTS = [
    (0.6, sql_text_mentions(_texts(TEAM_TEXT), ("email", "name", "phone", "title"), min_len=None)),
    (0.6, sql_text_mentions(_texts("cname || ' ' || title"), ("email", "name", "phone", "title"), min_len=None)),
    (0.5, sql_text_mentions(_texts(PAGE_TEXT), ("email", "name", "title"))),
    (0.5, sql_text_mentions(_texts("'Ask ' || person || ', ' || title"), ("email", "name", "title"))),
    (0.5, sql_text_mentions(f"(SELECT page_id, url, 'Write to ' || person AS text, 1 AS tid FROM {GEN} UNION ALL "
                            f"SELECT page_id, url, 'Profile', 2 FROM {GEN})", ("email", "name", "title"))),
    (0.5, f"SELECT page_id, url, type, value FROM ({VCARD_SQL}) v"),
    (0.5, f"SELECT page_id, url, type, value FROM ({JSONLD_SQL}) j"),
    (1.0, f"SELECT page_id, url, 'email' AS type, email || '?subject=hi' AS value FROM {GEN}"),
    (0.5, f"SELECT page_id, url, 'linkedin' AS type, 'https://www.linkedin.com/in/c' || cast(page_id AS string) AS value FROM {GEN}"),
]
CONTACT_INFO_SQL = ("SELECT DISTINCT page_id, url, type, value FROM ("
                    + " UNION ALL ".join(sql for _, sql in CONTACT_PARTS)
                    + ") m WHERE value IS NOT NULL AND value <> 'not_found'")


@query("pipe_contact_info", CONTACT_INFO_SQL)
def q_pipe_contact_info(spark, d):
    from sitesift.plans.contact import contact_info
    return contact_info(contact_pages(spark, d), titles=DEFAULT_TITLES, fuzzy=True).select("page_id", "url", "type", "value")


# ================================================================ token-table validation (V3, V5, V6, V7)
from sitesift.operators.validate import ADJECTIVES, DETERMINERS, NAME_RULE  # noqa: E402


def sql_tokens(vals):
    return f"""
SELECT value, i, t AS text,
       CASE WHEN lower(t) = 'of' THEN 'ADP' WHEN list_contains({sql_list(DETERMINERS)}, lower(t)) THEN 'DET'
            WHEN suffix(lower(t), 'ly') THEN 'ADV' WHEN list_contains({sql_list(ADJECTIVES)}, lower(t)) THEN 'ADJ'
            WHEN regexp_matches(t, '^[A-Z]') THEN 'PROPN' ELSE 'NOUN' END AS pos
FROM (SELECT value, unnest(string_split(value, ' ')) AS t, CAST(unnest(range(0, len(string_split(value, ' ')))) AS INTEGER) AS i
      FROM (SELECT DISTINCT value FROM {vals} WHERE value IS NOT NULL) d) x
WHERE t <> ''
"""


def sql_spans(tok):
    return f"""
SELECT value, span AS valid_title, i AS span_i, last AS span_last FROM (
  SELECT *, row_number() OVER (PARTITION BY value ORDER BY i, n) AS rk FROM (
    SELECT value, i,
      CASE WHEN (pos = 'ADJ' AND p1 = 'NOUN') OR (pos = 'NOUN' AND p1 = 'NOUN') THEN 2
           WHEN pos = 'PROPN' AND lower(t1) = 'of' AND p2 = 'PROPN' THEN 3 END AS n,
      CASE WHEN (pos = 'ADJ' AND p1 = 'NOUN') OR (pos = 'NOUN' AND p1 = 'NOUN') THEN text || ' ' || t1
           WHEN pos = 'PROPN' AND lower(t1) = 'of' AND p2 = 'PROPN' THEN text || ' ' || t1 || ' ' || t2 END AS span,
      CASE WHEN (pos = 'ADJ' AND p1 = 'NOUN') OR (pos = 'NOUN' AND p1 = 'NOUN') THEN i1
           WHEN pos = 'PROPN' AND lower(t1) = 'of' AND p2 = 'PROPN' THEN i2 END AS last
    FROM (SELECT value, i, text, pos,
                 lead(pos, 1) OVER w AS p1, lead(pos, 2) OVER w AS p2, lead(text, 1) OVER w AS t1,
                 lead(text, 2) OVER w AS t2, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2
          FROM ({tok}) tk WINDOW w AS (PARTITION BY value ORDER BY i)) a) b
  WHERE n IS NOT NULL) c WHERE rk = 1
"""


CONV_VALS = "(SELECT text AS value FROM conversations)"


def _conv_tokens(spark, d):
    from sitesift.operators.validate import rule_tokens
    return rule_tokens(T(spark, d, "conversations").select(F.col("text").alias("value")), titles=DEFAULT_TITLES)


@query("v_title", f"""
SELECT d.value, s.valid_title FROM (SELECT DISTINCT value FROM {CONV_VALS} v WHERE value IS NOT NULL) d
LEFT JOIN ({sql_spans(sql_tokens(CONV_VALS))}) s ON d.value = s.value
""")
def q_v_title(spark, d):
    from sitesift.operators.validate import title_spans
    vals = T(spark, d, "conversations").select(F.col("text").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return vals.join(title_spans(_conv_tokens(spark, d)), "value", "left").select("value", "valid_title")


ORG_PAIRS_SQL = """
SELECT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' of '
       || (CASE c_custkey % 3 WHEN 0 THEN 'Sales' WHEN 1 THEN 'Ana Lee' ELSE 'the Board' END) AS title,
       CASE WHEN c_custkey % 2 = 0 THEN 'Ana ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))
            ELSE NULL END AS name
FROM customer
"""
ORG_VALS = "(SELECT title AS value FROM (" + ORG_PAIRS_SQL + ") p)"


@query("v_org_enrich", f"""
SELECT title, name, organization FROM (
  SELECT p.title, p.name, t.text AS organization, row_number() OVER (PARTITION BY p.title, p.name ORDER BY t.i) AS rk
  FROM (SELECT DISTINCT title, name FROM ({ORG_PAIRS_SQL}) q) p
  JOIN ({sql_spans(sql_tokens(ORG_VALS))}) s ON s.value = p.title
  JOIN ({sql_tokens(ORG_VALS)}) t ON t.value = s.value AND t.pos = 'PROPN' AND t.i BETWEEN s.span_i AND s.span_last
  WHERE NOT contains(coalesce(p.name, ''), t.text)) x WHERE rk = 1
""")
def q_v_org_enrich(spark, d):
    from sitesift.operators.validate import org_from_titles, rule_tokens, title_spans
    T(spark, d, "customer").createOrReplaceTempView("customer")
    pairs = spark.sql(ORG_PAIRS_SQL).distinct()
    tok = rule_tokens(pairs.select(F.col("title").alias("value")), titles=DEFAULT_TITLES)
    sp = title_spans(tok).withColumnRenamed("value", "title")
    return org_from_titles(pairs.join(sp, "title"), tok).select("title", "name", F.col("title_org").alias("organization"))


RECORDS_SQL = f"""
SELECT CASE WHEN type = 'email' THEN value END AS email, CASE WHEN type = 'name' THEN value END AS name,
       CASE WHEN type = 'linkedin' THEN value END AS linkedin, CASE WHEN type = 'title' THEN value END AS title,
       CASE WHEN type = 'phone' THEN value END AS phone, CASE WHEN type = 'organization' THEN value END AS organization,
       url AS src_url
FROM ({CONTACT_INFO_SQL}) m
"""
# records of several fields: titles that are and are not found, phones that pass and fail
EXTRA_RECORDS_SQL = """
SELECT CASE c_custkey % 6 WHEN 0 THEN 'c' || cast(c_custkey AS string) || '@x.example.com' WHEN 1 THEN 'a@b.co|m' END AS email,
       CASE c_custkey % 5 WHEN 0 THEN 'Director Ruiz' WHEN 1 THEN 'Ana Lee' WHEN 2 THEN 'ana' END AS name,
       CASE c_custkey % 7 WHEN 0 THEN 'https://linkedin.com/in/c-' || cast(c_custkey AS string) WHEN 1 THEN 'https://x.com/in/c' END AS linkedin,
       CASE c_custkey % 4 WHEN 0 THEN 'senior engineer' WHEN 1 THEN 'Director of Sales' WHEN 2 THEN 'quickly'
            ELSE 'the project manager here' END AS title,
       CASE c_custkey % 3 WHEN 0 THEN '+1 212-555-' || lpad(cast(c_custkey % 10000 AS string), 4, '0')
            WHEN 1 THEN '(212) 555-0101' END AS phone,
       CASE c_custkey % 2 WHEN 0 THEN 'Org ' || c_mktsegment END AS organization,
       'http://x/' || cast(c_custkey AS string) AS src_url
FROM customer
"""
ALL_RECORDS_SQL = RECORDS_SQL + " UNION ALL " + EXTRA_RECORDS_SQL
REC_TITLES = "(SELECT title AS value FROM (" + ALL_RECORDS_SQL + ") r)"

V_RECORD_SQL = f"""
WITH r0 AS (SELECT row_number() OVER () AS rid, * FROM ({ALL_RECORDS_SQL}) a),
r AS (SELECT * REPLACE (CASE WHEN regexp_matches(name, '{NAME_RULE}')
                       AND len(list_filter(string_split(lower(name), ' '),
                                           lambda w: list_contains({sql_list([k.lower() for k in DEFAULT_TITLES])}, w))) = 0
                  THEN name END AS name) FROM r0),
sp AS ({sql_spans(sql_tokens(REC_TITLES))}),
tk AS ({sql_tokens(REC_TITLES)}),
org AS (SELECT r.rid, min_by(t.text, t.i) AS org FROM r JOIN sp ON sp.value = r.title JOIN tk t ON t.value = r.title
        WHERE t.pos = 'PROPN' AND t.i BETWEEN sp.span_i AND sp.span_last AND NOT contains(coalesce(r.name, ''), t.text)
        GROUP BY r.rid),
v AS (SELECT CASE WHEN regexp_matches(r.email, '{V_EMAIL_RE2}') THEN r.email END AS email, r.name,
             CASE WHEN regexp_matches(r.linkedin, '^https?://(?:www\\.)?linkedin\\.com/in/[\\w\\-]+/?$') THEN r.linkedin END AS linkedin,
             sp.valid_title AS title,
             CASE WHEN regexp_matches(r.phone, '{V_PHONE_RE2}') THEN r.phone END AS phone,
             coalesce(org.org, r.organization) AS organization, r.src_url
      FROM r LEFT JOIN sp ON sp.value = r.title LEFT JOIN org ON org.rid = r.rid)
SELECT * FROM v WHERE coalesce(email, name, linkedin, title, phone) IS NOT NULL
"""


def _all_records(spark, d):
    from sitesift.operators.aggregate import sparse_records, union_all
    mentions = sparse_records(q_pipe_contact_info(spark, d))
    T(spark, d, "customer").createOrReplaceTempView("customer")
    return union_all(mentions, spark.sql(EXTRA_RECORDS_SQL))


@query("v_record", V_RECORD_SQL)
def q_v_record(spark, d):
    from sitesift.operators.validate import validate_records
    return validate_records(_all_records(spark, d), titles=DEFAULT_TITLES)


@query("v_record_tokens", V_RECORD_SQL)
def q_v_record_tokens(spark, d):
    """The same records with names and titles looked up in a token table."""
    from sitesift.operators.validate import rule_tokens, validate_records
    from sitesift.session import stored
    r = stored(_all_records(spark, d), "records")
    values = r.select(F.explode(F.array("title", "name")).alias("value"))
    return validate_records(r, tokens=rule_tokens(values, titles=DEFAULT_TITLES), titles=DEFAULT_TITLES)


@query("v_name_entities", f"""
SELECT d.value, CASE WHEN regexp_matches(d.value, '{NAME_RULE}')
                      AND len(list_filter(string_split(lower(d.value), ' '),
                              lambda w: list_contains({sql_list([k.lower() for k in DEFAULT_TITLES])}, w))) = 0
                     THEN d.value END AS valid_name
FROM (SELECT DISTINCT value FROM ({CONTACT_INFO_SQL}) m WHERE type = 'name') d
""")
def q_v_name_entities(spark, d):
    from sitesift.operators.validate import entity_names, rule_tokens
    # written: they are read as values and as tokens, and are few beside the pages they come from
    vals = stored(q_pipe_contact_info(spark, d).filter(F.col("type") == "name").select("value").distinct(), "names")
    return vals.join(entity_names(rule_tokens(vals, titles=DEFAULT_TITLES)), "value", "left").select("value", "valid_name")


# ================================================================ confidence, union of profiles, plug-ins
@query("agg_confidence", "SELECT url, type, value, max(conf) AS confidence FROM (" + " UNION ALL ".join(
    f"SELECT url, type, value, CAST({c} AS DOUBLE) AS conf FROM ({sql}) p{i}" for i, (c, sql) in enumerate(CONTACT_PARTS))
    + ") m WHERE value IS NOT NULL GROUP BY url, type, value")
def q_agg_confidence(spark, d):
    from sitesift.operators.aggregate import mention_confidence
    from sitesift.plans.contact import contextual_mentions, parsed_pages
    m = contextual_mentions(parsed_pages(contact_pages(spark, d)), titles=DEFAULT_TITLES, fuzzy=True)
    return mention_confidence(m.filter(F.col("value").isNotNull()))


WEIGHTED_SQL = """
SELECT 'http://n' || cast(c_nationkey AS string) AS url, 'email' AS type, c_mktsegment AS value,
       CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS weight,
       CASE c_custkey % 3 WHEN 0 THEN CAST(0.9 AS DOUBLE) WHEN 1 THEN CAST(0.25 AS DOUBLE) END AS confidence
FROM customer WHERE c_custkey % 4 <> c_nationkey % 4
"""


@query("agg_confidence_weights", f"""
SELECT url, type, value, max(least(coalesce(confidence, {BASE_CONFIDENCE}) * CASE weight
  {" ".join(f"WHEN '{w}' THEN CAST({f} AS DOUBLE)" for w, f in WEIGHT_FACTOR.items())} ELSE 1.0 END, 1.0)) AS confidence
FROM ({WEIGHTED_SQL}) w GROUP BY url, type, value
""")
def q_agg_confidence_weights(spark, d):
    from sitesift.operators.aggregate import mention_confidence
    T(spark, d, "customer").createOrReplaceTempView("customer")
    return mention_confidence(spark.sql(WEIGHTED_SQL))


@query("agg_union_profiles", f"SELECT DISTINCT page_id, url, type, value FROM ({CONTACT_INFO_SQL} UNION ALL {WRAPPER_ALL_SQL}) u")
def q_agg_union_profiles(spark, d):
    from sitesift.operators.aggregate import distinct_mentions, union_all
    from sitesift.plans.contact import contextual_mentions, parsed_pages, wrapper_mentions
    p = parsed_pages(contact_pages(spark, d), keep=True)
    u = union_all(contextual_mentions(p, titles=DEFAULT_TITLES, fuzzy=True), wrapper_mentions(p))
    return distinct_mentions(u)


@query("ext_custom", f"""
SELECT doc_id, 'email' AS type, unnest(regexp_extract_all({sql_clean('lower(text)')}, '{RE2_EMAIL}')) AS value FROM documents
UNION ALL
SELECT doc_id, 'number', unnest(regexp_extract_all(text, '{FIND_ALL_PATTERN}')) FROM documents
""")
def q_ext_custom(spark, d):
    from sitesift.functions.text import emails_in
    from sitesift.operators.extract import default_registry
    reg = (default_registry(DEFAULT_TITLES)
           .register("number", lambda c: find_all(c, FIND_ALL_PATTERN))
           .register("email", lambda c: emails_in(F.lower(c))))   # a later registration replaces the default
    return reg.extract(_docs(spark, d), "text", ids=("doc_id",), names=["email", "number", "no_such_extractor"])


# ================================================================ sinks
@query("sink_csv", f"""
SELECT coalesce(name, '') AS name, coalesce(title, '') AS title, coalesce(email, '') AS email,
       coalesce(linkedin, '') AS linkedin, coalesce(src_url, '') AS src_url FROM ({V_RECORD_SQL}) v
""")
def q_sink_csv(spark, d):
    """Validated records written as CSV to the shared folder, read back."""
    from sitesift.session import scratch_path
    from sitesift.sources.readers import read_contacts_csv
    from sitesift.sources.sinks import write_contacts_csv
    path = scratch_path(spark, "records_csv")
    write_contacts_csv(q_v_record(spark, d), path)
    return read_contacts_csv(spark, path)


@query("src_csv", f"""
SELECT coalesce('  ' || name || chr(9), '') AS name, coalesce(title, '') AS title, coalesce(email, '') AS email,
       coalesce(linkedin, '') AS linkedin, coalesce(src_url, '') AS src_url FROM ({RECORDS_SQL}) v
""")
def q_src_csv(spark, d):
    """Round trip: contact records, names between spaces, written as CSV to the shared
    scratch folder, read back."""
    from sitesift.operators.aggregate import sparse_records
    from sitesift.session import scratch_path
    from sitesift.sources.readers import read_contacts_csv
    from sitesift.sources.sinks import write_contacts_csv
    path = scratch_path(spark, "contacts_csv")
    records = sparse_records(q_pipe_contact_info(spark, d))
    write_contacts_csv(records.withColumn("name", F.concat(F.lit("  "), "name", F.lit("\t"))), path)
    return read_contacts_csv(spark, path)


@query("sink_json", f"""
SELECT url, CAST(to_json(list_sort(list(DISTINCT {{'type': type, 'value': value}}))) AS VARCHAR) AS extracted_info
FROM ({CONTACT_INFO_SQL}) m GROUP BY url
""")
def q_sink_json(spark, d):
    """Nested results written as JSON lines to the shared folder, read back as text."""
    from sitesift.session import scratch_path
    from sitesift.sources.sinks import nested_results, write_json
    path = scratch_path(spark, "nested_json")
    write_json(nested_results(q_pipe_contact_info(spark, d)), path)
    line = spark.read.text(path)
    return line.select(F.get_json_object("value", "$.url").alias("url"),
                       F.get_json_object("value", "$.extracted_info").alias("extracted_info"))


@query("sink_json_seeds", f"""
SELECT 'http://site' || cast(page_id // 50 AS string) AS seed, url,
       CAST(to_json(list_sort(list(DISTINCT {{'type': type, 'value': value}}))) AS VARCHAR) AS extracted_info
FROM ({CONTACT_INFO_SQL}) m GROUP BY ALL
""")
def q_sink_json_seeds(spark, d):
    """One object per seed holding its pages (a crawl's cap of 50 at most), written and
    read back, one row per page."""
    from sitesift.session import scratch_path
    from sitesift.sources.sinks import nested_by_seed, write_json
    seed = F.concat(F.lit("http://site"), F.expr("page_id div 50").cast("string"))
    path = scratch_path(spark, "seed_json")
    write_json(nested_by_seed(q_pipe_contact_info(spark, d).withColumn("seed", seed)), path)
    info = "array<struct<type:string,value:string>>"
    back = spark.read.schema(f"seed string, pages map<string,{info}>").json(path)
    return (back.select("seed", F.explode("pages").alias("url", "i"))
            .select("seed", "url", F.to_json("i").alias("extracted_info")))


# pages that the tokenizer refuses: a mail address in them is not found, the other pages go on
BROKEN_SQL = """SELECT -2 - c_custkey AS page_id, 'http://broken/' || cast(c_custkey AS string) AS url,
  '<p>a@b.example.com</p>' || CASE c_custkey % 2 WHEN 0 THEN '<![foo[x]]>' ELSE '<![ x>' END AS html
FROM customer WHERE c_custkey % 7 = 0"""
FAILED_SQL = "SELECT page_id, url, 'error' AS level, 'HTTP 500' AS message FROM " + GEN + " WHERE page_id % 11 = 0"


@query("sink_page_status", f"""
SELECT g.page_id, g.url, CASE WHEN g.page_id % 11 = 0 THEN 'failure' ELSE 'success' END AS status,
       CASE WHEN g.page_id % 11 = 0 THEN 'HTTP 500' ELSE '' END AS errors,
       CASE WHEN g.seg = 'MACHINERY' THEN 'JSON-LD could not be parsed' ELSE '' END AS warnings,
       CASE WHEN g.page_id % 11 = 0 THEN '[]' ELSE CAST(to_json(coalesce(i.info, [])) AS VARCHAR) END AS extracted_info
FROM {GEN} LEFT JOIN (SELECT page_id, list_sort(list(DISTINCT {{'type': type, 'value': value}})) AS info
                      FROM ({CONTACT_INFO_SQL}) m GROUP BY page_id) i ON g.page_id = i.page_id
UNION ALL SELECT -1, 'http://empty', 'success', '', 'Empty HTML content', '[]'
UNION ALL SELECT -2 - c_custkey, 'http://broken/' || cast(c_custkey AS string), 'failure', 'page could not be parsed', '', '[]'
FROM customer WHERE c_custkey % 7 = 0
""")
def q_sink_page_status(spark, d):
    from sitesift.plans.contact import contact_info, parsed_pages
    from sitesift.sources.sinks import page_status
    pages = contact_pages(spark, d)
    broken = deal(spark.sql(BROKEN_SQL))
    parsed = parsed_pages(pages.unionByName(broken), keep=True)
    problems = S.jsonld_problems(parsed).unionByName(parse_problems(parsed)).unionByName(spark.sql(FAILED_SQL))
    empty = spark.createDataFrame([(-1, "http://empty", "")], "page_id long, url string, html string")
    found = contact_info(pages, titles=DEFAULT_TITLES, fuzzy=True, parsed=parsed)
    st = page_status(pages.unionByName(broken).unionByName(empty), found, problems)
    # the parser's own words behind the colon are left out
    return st.select("page_id", "url", "status", F.regexp_extract(F.array_join("errors", ";"), "^[^:]*", 0).alias("errors"),
                     F.array_join("warnings", ";").alias("warnings"), F.to_json("extracted_info").alias("extracted_info"))


# ================================================================ site runs and link crawl
# every page of the link trees names an address of its own, so the rows tell which pages the
# crawl took: depth 3, at most BUDGET pages per seed, the seed's site only
SITE_MAIL = "'m' || cast(n AS string) || '@t' || cast(site AS string) || '.example.com'"
SITE_HTML_SQL = f"""
SELECT page_id, url, replace(html, '</body>', '<p> . mail ' || {SITE_MAIL} || ' . </p></body>') AS html FROM {LGEN}
"""


@query("pipe_site", f"""
SELECT '' AS name, '' AS title, {SITE_MAIL} AS email, '' AS linkedin, p.url AS src_url
FROM (SELECT seed, url, row_number() OVER (PARTITION BY seed ORDER BY depth, priority, url) AS rank FROM ({BFS_SQL}) b) t
JOIN {LGEN.replace(") lg", ") p")} ON p.url = t.url WHERE t.rank <= {BUDGET}
""")
def q_pipe_site(spark, d):
    """Q3: every link-tree root is a seed; crawl, extract, validate, CSV shape. Pages
    without a site among the seeds are in the table too."""
    from sitesift.plans.site import site_contacts
    register_views(spark, d, ["customer", "nation"])
    pages = spark.sql(SITE_HTML_SQL).unionByName(contact_pages(spark, d))
    return site_contacts(link_seeds(spark, d), pages, max_depth=3, max_pages=BUDGET, titles=DEFAULT_TITLES, fuzzy=True)


LINK_UNIQUE_SQL = f"""
SELECT DISTINCT {sql_norm('src_url')} AS src, {sql_norm('abs_url')} AS dst FROM (
  SELECT src_url, href, CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//')
                             THEN lower({sql_url_part('src_url', 2)}) || '://' || {sql_netloc('src_url')} || href
                             WHEN {sql_netloc('href')} <> '' THEN href END AS abs_url
  FROM (SELECT url AS src_url, unnest(regexp_extract_all(html, 'href="(.*?)"', 1)) AS href FROM {LGEN}) h) j
WHERE abs_url IS NOT NULL AND {sql_norm('abs_url')} IS NOT NULL
  AND NOT (regexp_matches(abs_url, '\\.(json|css|png|jpg|svg|ico|js|gif|pdf|xml)$') OR starts_with(abs_url, 'mailto'))
"""


@query("pipe_link_crawl", f"""
WITH RECURSIVE e AS ({LINK_UNIQUE_SQL}),
reach(norm_url, step) AS (
  SELECT {sql_norm('url')}, 0 FROM {LGEN} WHERE n = 0
  UNION
  SELECT e.dst, r.step + 1 FROM reach r JOIN e ON e.src = r.norm_url WHERE r.step < 64),
best AS (SELECT norm_url, min(step) AS step FROM reach GROUP BY norm_url)
SELECT b.norm_url, b.step, p.page_id, p.url FROM best b JOIN (SELECT page_id, url, {sql_norm('url')} AS nu FROM {LGEN}) p
  ON p.nu = b.norm_url
""")
def q_pipe_link_crawl(spark, d):
    from sitesift.plans.site import link_closure
    r = link_closure(link_seeds(spark, d), link_pages(spark, d))
    return r.select("norm_url", "step", "page_id", "url")


@query("pipe_link_info", f"""
WITH RECURSIVE e AS ({LINK_UNIQUE_SQL}),
reach(norm_url, step) AS (
  SELECT {sql_norm('url')}, 0 FROM {LGEN} WHERE n = 0
  UNION
  SELECT e.dst, r.step + 1 FROM reach r JOIN e ON e.src = r.norm_url WHERE r.step < 64),
best AS (SELECT norm_url, min(step) AS step FROM reach GROUP BY norm_url)
SELECT p.page_id, p.url, b.step, 'email' AS type, {SITE_MAIL} AS value
FROM best b JOIN {LGEN.replace(") lg", ") p")} ON {sql_norm('p.url')} = b.norm_url
""")
def q_pipe_link_info(spark, d):
    """Q4 with extraction: the addresses on every page of the closure."""
    from sitesift.plans.site import link_crawl_info
    register_views(spark, d, ["customer"])
    found = link_crawl_info(link_seeds(spark, d), spark.sql(SITE_HTML_SQL), titles=DEFAULT_TITLES, fuzzy=False)
    return found.where("type = 'email'").select("page_id", "url", "step", "type", "value")


# ================================================================ streaming (equals the batch result)
@query("stream_contacts", f"SELECT DISTINCT page_id, url, type, value FROM ({sql_doc_mentions('documents')}) m")
def q_stream_contacts(spark, d):
    from sitesift.streaming.jobs import stream_contacts
    return stream_contacts(spark, d, titles=DEFAULT_TITLES)


@query("stream_visited", ORACLE["url_normalize"])
def q_stream_visited(spark, d):
    from sitesift.streaming.jobs import stream_visited
    return stream_visited(spark, d)


@query("stream_rate", ORACLE["crawl_rate_audit"])
def q_stream_rate(spark, d):
    from sitesift.streaming.jobs import stream_rate
    return stream_rate(spark, d, period="1 day", limit=3, delay="1 day")


@query("agg_contact_wide", f"""
SELECT url, {", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE type = '{t}')), '; '), '') AS {t}"
                       for t in ["email", "name", "linkedin", "title", "phone", "organization"])}
FROM ({CONTACT_INFO_SQL}) m GROUP BY url
""")
def q_agg_contact_wide(spark, d):
    """A4 wide form: one row per page, each type's distinct values sorted and joined by '; '."""
    from sitesift.operators.aggregate import RECORD_TYPES, wide_records
    w = wide_records(q_pipe_contact_info(spark, d))
    return w.select("url", *[F.array_join(F.coalesce(F.col(t), F.array().cast("array<string>")), "; ").alias(t)
                             for t in RECORD_TYPES])
