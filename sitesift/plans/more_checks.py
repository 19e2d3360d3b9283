"""Registered queries of deep link closures, failing extractors, SQL table functions and
stateful streams, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.plans.checks import LGEN, LINKS_SCORED_SQL, ORACLE, T, query, sql_netloc
from sitesift.session import deal

# ---- link closure of deep graphs ---------------------------------------------------------
# sites of 5,000 pages from the orders: each page leads to the next, back and home; the home
# page also leads 100 pages on
DEEP = 5000
DEEP_PAGES_SQL = f"""
SELECT CAST(o_orderkey AS bigint) AS page_id, 'http://s' || CAST(CAST(floor(o_orderkey / {DEEP}) AS bigint) AS string) || '.example.com/p/' ||
         CAST(o_orderkey % {DEEP} AS string) AS url,
       '<a href="/p/0">home</a><a href="/p/' || CAST(o_orderkey % {DEEP} + 1 AS string) || '">next</a><a href="/p/' ||
         CAST(greatest(o_orderkey % {DEEP} - 1, 0) AS string) || '">back</a>' ||
         CASE WHEN o_orderkey % {DEEP} = 0 THEN '<a href="/p/100">skip</a>' ELSE '' END AS html
FROM orders
"""


def deep_pages(spark, d):
    """Rows of orders are dealt out before they become pages: the table is small in bytes."""
    deal(T(spark, d, "orders").select("o_orderkey")).createOrReplaceTempView("orders")
    return spark.sql(DEEP_PAGES_SQL)


@query("pipe_link_closure_deep", f"""
SELECT CAST(o_orderkey AS BIGINT) AS page_id,
       CAST(least(o_orderkey % {DEEP}, 1 + abs(o_orderkey % {DEEP} - 100)) AS INTEGER) AS step
FROM orders o
WHERE (SELECT count(*) FROM orders p WHERE floor(p.o_orderkey / {DEEP}) = floor(o.o_orderkey / {DEEP}) AND p.o_orderkey <= o.o_orderkey)
      = o.o_orderkey % {DEEP} + 1
""")
def q_pipe_link_closure_deep(spark, d):
    """Steps of all pages of sites that are chains of thousands of pages."""
    from sitesift.plans.site import link_closure
    pages = deep_pages(spark, d)
    seeds = pages.where(F.col("page_id") % DEEP == 0).select(F.col("url").alias("seed"))
    return link_closure(seeds, pages).select("page_id", F.col("step").cast("int").alias("step"))


# ---- extractors that fail ------------------------------------------------------------------

def leading_number(text: str) -> list[str]:
    """A plug-in that raises on texts whose length is a multiple of seven."""
    if len(text) % 7 == 0:
        raise ValueError("length")
    return [str(len(text)), text[:1]]


@query("x_safe_extract_failures", """
SELECT conv_id, turn, 'lead' AS type, value, CAST(NULL AS VARCHAR) AS message
FROM (SELECT conv_id, turn, unnest([CAST(length(text) AS VARCHAR), substr(text, 1, 1)]) AS value
      FROM conversations WHERE length(text) >= 3 AND length(text) % 7 <> 0) a
UNION ALL SELECT conv_id, turn, 'lead', NULL, 'extractor lead failed: ValueError: length' FROM conversations WHERE length(text) >= 3 AND length(text) % 7 = 0
UNION ALL SELECT conv_id, turn, 'number', unnest(regexp_extract_all(text, '[0-9]{2,}')), NULL FROM conversations WHERE length(text) >= 3
""")
def q_x_safe_extract_failures(spark, d):
    """A failing plug-in beside a column extractor over all conversations."""
    from sitesift.functions.text import find_all
    from sitesift.operators.extract import ExtractorRegistry
    reg = ExtractorRegistry().register_plain("lead", leading_number).register("number", lambda c: find_all(c, "[0-9]{2,}"))
    found = reg.extract_safely(T(spark, d, "conversations"), "text", ids=("conv_id", "turn"))
    return found.select("conv_id", "turn", "type", "value", "message")


# ---- parsing from SQL ----------------------------------------------------------------------

@query("html_elements_sql", ORACLE["html_elements"])
def q_html_elements_sql(spark, d):
    """The element table of all pages through the lateral table function."""
    from sitesift.functions.tables import register_table_functions
    register_table_functions(spark)
    T(spark, d, "pages").createOrReplaceTempView("pages")
    return spark.sql("SELECT page_id, tag, count(*) AS n FROM pages, LATERAL html_elements(html) GROUP BY page_id, tag")


# ---- stateful streams ----------------------------------------------------------------------
VISIT_URL = "'http://u' || CAST(user_id AS string) || '.example.com/' || event_type"
REVISIT_SECONDS = 6 * 3600


@query("stream_revisits", f"""
SELECT url, CAST(epoch_us(ts) AS BIGINT) AS us FROM (
  SELECT url, ts, lag(ts) OVER (PARTITION BY url ORDER BY ts) AS before FROM (SELECT {VISIT_URL.replace('string', 'VARCHAR')} AS url, ts FROM events) e) x
WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > {REVISIT_SECONDS}000000
""")
def q_stream_revisits(spark, d):
    """Visits to URLs not visited within six hours before, as a stream with bounded state."""
    from sitesift.streaming.jobs import stream_revisits
    found, _ = stream_revisits(spark, d, ttl_seconds=REVISIT_SECONDS,
                               select=lambda e: e.select(F.expr(VISIT_URL).alias("url"), "ts"))
    return found.select("url", F.unix_micros("ts").alias("us"))


@query("stream_url_queue", f"""
SELECT dst_url AS url, CAST(min(100 - score) AS BIGINT) AS priority, CAST(1 AS BIGINT) AS depth FROM ({LINKS_SCORED_SQL}) s
WHERE score > 0 AND {sql_netloc('dst_url')} = {sql_netloc('src_url')} AND dst_url NOT IN (SELECT url FROM {LGEN}) GROUP BY dst_url
""")
def q_stream_url_queue(spark, d):
    """URLs that the pages of the link trees bring to the queue, while they arrive as files."""
    from sitesift.plans.generated import link_pages
    from sitesift.session import scratch_path
    from sitesift.streaming.jobs import stream_url_queue
    folder = scratch_path(spark, "arriving")
    link_pages(spark, d).select("page_id", "url", "html").write.parquet(f"{folder}/pages")
    return stream_url_queue(spark, folder)[0]
