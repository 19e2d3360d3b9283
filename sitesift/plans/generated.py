"""Inputs derived by SQL from the given tables, for operators the test pages
cannot exercise (vCards, JSON-LD, mailto, context blocks, link trees).

The SQL text runs unchanged on Spark and on DuckDB, so an independent oracle
can state the expected mentions straight from the source columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitesift.session import deal

# one contact page per customer; person, title, e-mail and phone follow from the row
CONTACT_BASE_SQL = """
SELECT c.c_custkey AS page_id,
       'http://site' || cast(c.c_custkey % 50 AS string) || '.example.com/about/' || cast(c.c_custkey AS string) AS url,
       c.c_name AS cname, n.n_name AS nname, c.c_mktsegment AS seg,
       (CASE c.c_custkey % 8 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Omar' WHEN 2 THEN 'Lena' WHEN 3 THEN 'Ravi'
             WHEN 4 THEN 'Yuki' WHEN 5 THEN 'Ines' WHEN 6 THEN 'Jonas' ELSE 'Mira' END)
         || ' ' || upper(substr(c.c_mktsegment, 1, 1)) || lower(substr(c.c_mktsegment, 2)) AS person,
       (CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Project Manager' WHEN 'MACHINERY' THEN 'Chief Engineer'
             WHEN 'AUTOMOBILE' THEN 'Sales Director' WHEN 'HOUSEHOLD' THEN 'Office Manager'
             ELSE 'Lead Designer' END) AS title,
       'c' || cast(c.c_custkey AS string) || '@site' || cast(c.c_custkey % 50 AS string) || '.example.com' AS email,
       '(212) 555-' || lpad(cast(c.c_custkey % 10000 AS string), 4, '0') AS phone
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

CONTACT_HTML_OF = """
SELECT page_id, url, cname, nname, seg, person, title, email, phone,
  '<html><head><title>' || cname || '</title>'
  || '<meta name="description" content="Ask ' || person || ', ' || title || '">'
  || '<meta name="viewport" content="width=device-width">'
  || '<script type="application/ld+json">'
  || (CASE seg
        WHEN 'BUILDING' THEN '{"@type":"Organization","name":"Org ' || nname || '","telephone":"' || phone || '"}'
        WHEN 'MACHINERY' THEN '{bad'
        WHEN 'AUTOMOBILE' THEN '[{"@type":"Person","name":"' || person || '","jobTitle":"' || title
                               || '","email":"' || email || '"}]'
        WHEN 'HOUSEHOLD' THEN '{"@type":"Person","name":{"first":"x"},"email":"' || email || '"}'
        ELSE '[]' END)
  || '</script></head><body>'
  || '<div class="vcard"><span class="fn">' || person || '</span> . <span class="org">Org ' || nname
  || '</span> . <span class="email">' || email || '</span> . <span class="tel">' || phone || '</span></div>'
  || '<p> . </p><div id="team-' || cast(page_id AS string) || '"><p>' || person || ' - ' || title
  || '</p> . <p>Mail ' || email || '</p> . <p>Tel ' || phone || '</p></div>'
  || '<p> . </p><h2>Our People</h2><section>' || cname || ' ' || title || '</section>'
  || '<p> . </p><span class="contact">Call ' || phone || '</span>'
  || '<p> . </p><a href="mailto:' || email || '?subject=hi">Write to ' || person || '</a>'
  || '<p> . </p><a href="https://www.linkedin.com/in/c' || cast(page_id AS string) || '">Profile</a>'
  || '</body></html>' AS html
FROM """
CONTACT_HTML_SQL = CONTACT_HTML_OF + "(" + CONTACT_BASE_SQL + ") b\n"

# one site per nation; the customers of a nation, numbered n = 0.., form a binary
# tree (n links to 2n+1 and 2n+2) with back-links, one deep link (score 0), one
# cross-host link, a .pdf and a tel: link; even pages live under /team/
LINK_BASE_SQL = """
SELECT c_custkey AS page_id, c_nationkey AS site, c_mktsegment AS seg,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n
FROM customer
"""

LINK_HTML_OF = """
SELECT page_id, site, n,
  'http://t' || cast(site AS string) || '.example.com'
  || (CASE WHEN n > 0 AND n % 2 = 0 THEN '/team/' ELSE '/p/' END) || cast(n AS string) AS url,
  '<html><body><h1>Page ' || cast(n AS string) || '</h1><ul>'
  || '<li><a href="' || (CASE WHEN (2 * n + 1) % 2 = 0 THEN '/team/' ELSE '/p/' END) || cast(2 * n + 1 AS string)
  || '">' || lower(seg) || '</a></li>'
  || '<li><a href="/team/' || cast(2 * n + 2 AS string) || '">Our team</a></li>'
  || (CASE WHEN n > 0 THEN '<li><a href="'
        || (CASE WHEN cast(floor((n - 1) / 2) AS bigint) > 0 AND cast(floor((n - 1) / 2) AS bigint) % 2 = 0
                 THEN '/team/' ELSE '/p/' END)
        || cast(cast(floor((n - 1) / 2) AS bigint) AS string) || '">up</a></li>' ELSE '' END)
  || '<li><a href="/a/b/c/' || cast(n AS string) || '">archive</a></li>'
  || '<li><a href="http://other.example.org/p/' || cast(n AS string) || '">partner</a></li>'
  || '<li><a href="/files/' || cast(n AS string) || '.pdf">report</a></li>'
  || '<li><a href="tel:555' || cast(n AS string) || '">call</a></li>'
  || '</ul></body></html>' AS html
FROM """
LINK_HTML_SQL = LINK_HTML_OF + "(" + LINK_BASE_SQL + ") b\n"

LINK_SEEDS_SQL = "SELECT url AS seed FROM (" + LINK_HTML_SQL + ") g WHERE n = 0"


def register_views(spark: SparkSession, sf_dir: str, names) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet").createOrReplaceTempView(n)


def contact_pages(spark: SparkSession, sf_dir: str, full: bool = False) -> DataFrame:
    """Rows of a few columns are dealt out before they become pages: the tables are small in
    bytes, read as one split, but every row is a page to parse. They are dealt out as they are
    read, so that the one split's task neither joins nor makes text."""
    register_views(spark, sf_dir, ["nation"])
    deal(spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet")).createOrReplaceTempView("customer")
    df = spark.sql(CONTACT_HTML_SQL)
    return df if full else df.select("page_id", "url", "html")


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ["customer"])
    deal(spark.sql(LINK_BASE_SQL)).createOrReplaceTempView("link_base")
    return spark.sql(LINK_HTML_OF + "link_base").select("page_id", "url", "html")


def link_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ["customer"])
    return spark.sql(LINK_SEEDS_SQL)
