"""Links and URLs: resolution, filtering, per-page unique links, link graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions.urls import (is_html_url, normalize_url, with_joined_url, url_fragment, url_netloc,
                                     url_path, url_query, url_scheme)
from sitesift.operators.structure import hrefs_raw


def parse_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """Scheme, netloc, path, query, fragment; rows without a netloc are dropped."""
    c = F.col(col)
    return (df.withColumn("scheme", url_scheme(c)).withColumn("netloc", url_netloc(c))
            .withColumn("path", url_path(c)).withColumn("query", url_query(c))
            .withColumn("fragment", url_fragment(c)).filter(F.col("netloc") != ""))


def _resolved(pages: DataFrame, keep: Callable[[Column], Column], only=lambda h: h) -> DataFrame:
    """(page_id, url, pos, href, abs_url, norm_url, _ok): every link (of those that ``only``
    leaves), and whether it passes."""
    h = with_joined_url(only(hrefs_raw(pages)), "url", "href", "_joined")
    h = h.withColumn("abs_url", F.when(url_netloc(F.col("href")) == "", F.col("_joined"))
                     .otherwise(F.col("href"))).drop("_joined")
    h = h.withColumn("norm_url", normalize_url(F.col("abs_url")))
    return h.withColumn("_ok", F.coalesce(keep(F.col("abs_url")), F.lit(False)) & F.col("norm_url").isNotNull())


# Plainly written URLs, whose parts are where a look at them finds them: of a page the scheme and
# netloc; of a link a path from the root without "." and ".." (its segments begin with no dot), or all
PLAIN_BASE = r"^(https?://[A-Za-z0-9._:-]+)(?:/[!\x22$->@-~]*)?\z"
PLAIN_PATH = r"^(?:/[A-Za-z0-9_~%:@,+=-][A-Za-z0-9._~%:@,+=-]*)*/?\z"
PLAIN_URL = r"^https?://[A-Za-z0-9._:-]+(?:/[A-Za-z0-9._~%:@,+=/-]*)?\z"


def link_edges(pages: DataFrame, keep: Callable[[Column], Column] = is_html_url) -> DataFrame:
    """(src, dst): the links of ``unique_links`` between normalized URLs, without a shuffle.
    Links that a page repeats are repeated, ``dst`` is null for links that fail (a filter
    here would multiply the URL expressions, see ``unique_links``). Plainly written links
    are put together without the expressions that take any URL apart."""
    # once for a page: its normalized URL in place of the id, the root that its links start from
    own = pages.select(F.struct(normalize_url(F.col("url")).alias("src"), F.coalesce(F.regexp_extract("url", PLAIN_BASE, 1), F.lit("")).alias("root"))
                       .alias("page_id"), "url", "html")
    href, root = F.col("href"), F.col("page_id.root")
    plain = href.rlike(PLAIN_URL) | ((root != "") & (href != "") & href.rlike(PLAIN_PATH))
    easy = hrefs_raw(own).where(plain)
    whole = F.when(href.startswith("/"), F.concat(root, href)).otherwise(href)
    norm = F.concat(F.lit("http://"), F.lower(whole.substr(F.instr(whole, "://") + 3, F.length(whole))))
    easy = easy.select(F.col("page_id.src").alias("src"), F.when(F.coalesce(keep(whole), F.lit(False)), norm).alias("dst"))
    odd = _resolved(own, keep, lambda h: h.where(~plain))
    return easy.unionByName(odd.select(F.col("page_id.src").alias("src"), F.when(F.col("_ok"), F.col("norm_url")).alias("dst")))


def unique_links(pages: DataFrame, keep: Callable[[Column], Column] = is_html_url) -> DataFrame:
    """Raw hrefs -> absolute (joined only when the href has no netloc) -> URLs that
    fail ``keep`` (a predicate on the absolute URL; by default non-HTML and mailto ones)
    dropped -> URLs without a netloc dropped -> one row per (page, normalized URL), the
    first link in document order that passes.

    Rows are dropped through the aggregate (``keep`` = the group's URL is
    valid), not by a filter under it, so the URL resolution is planned once
    and the aggregation is still combined map-side before the shuffle.
    """
    h = _resolved(pages, keep)
    # the order is null, so never smallest, for links that fail
    first = F.min_by(F.struct("pos", "href", "abs_url"), F.when(F.col("_ok"), F.col("pos")))
    g = h.groupBy("page_id", "url", "norm_url").agg(first.alias("f"), F.max("_ok").alias("keep"))
    return g.filter(F.col("keep")).select("page_id", "url", "norm_url", "f.pos", "f.href", "f.abs_url")


def link_graph(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row per URL seen as a page or a link target: out-degree, in-degree
    (distinct linking pages) and whether the URL is a stored page. Counts are
    partial-aggregated before the shuffle, so a hub target is cheap."""
    links = unique_links(pages) if links is None else links
    src = pages.select(normalize_url(F.col("url")).alias("node"), F.lit(1).alias("is_page"))
    src = src.filter(F.col("node").isNotNull())
    edges = links.select(normalize_url(F.col("url")).alias("src"), F.col("norm_url").alias("dst")) \
        .filter(F.col("src").isNotNull()).distinct()
    outd = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    ind = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    pg = src.groupBy("node").agg(F.max("is_page").alias("is_page"))
    return (pg.join(outd, "node", "full").join(ind, "node", "full")
            .select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                    F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
                    F.coalesce("is_page", F.lit(0)).alias("is_page")))
