"""Crawl planning over a stored page table.

Pages arrive as a table; the crawl decides which stored pages a bounded
best-first crawl from each seed reaches. The traversal is level-synchronous:
at most ``max_depth`` distributed join steps (frontier x link edges, anti-join
on the visited set), each written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.dictionaries import URL_KEYWORDS
from sitesift.functions.text import lit_array
from sitesift.functions.urls import normalize_url, url_netloc, url_path_noparams, with_joined_url
from sitesift.operators.htmltree import parse_pages
from sitesift.operators.structure import links as page_links
from sitesift.session import stored


def with_relevance(df: DataFrame, url_col: str, text_col: str, out: str = "score", keywords=None) -> DataFrame:
    """+5 if the lower-cased path (without ;params) contains a keyword, +3 if the
    lower-cased link text does, plus max(0, 3 - number of '/' in the path). The path is
    staged, so the keyword loop reads a column. ``keywords``: a list, or a DataFrame
    (keyword, ord) of any size, joined with the distinct paths and link texts."""
    df = df.withColumn("_rel_path", F.lower(url_path_noparams(F.col(url_col)))) \
        .withColumn("_rel_text", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    if isinstance(keywords, DataFrame):
        from sitesift.operators.vocabulary import holding_any

        df = stored(df, "relevance")
        strings = df.select(F.explode(F.array("_rel_path", "_rel_text")).alias("s"))
        told = holding_any(strings, "s", keywords)
        for c in ("_rel_path", "_rel_text"):
            df = df.join(told.select(F.col("s").alias(c), F.lit(True).alias(f"{c}_told")), c, "left")
        return df.withColumn(out, _points(F.coalesce("_rel_path_told", F.lit(False)), F.coalesce("_rel_text_told", F.lit(False)),
                                          F.col("_rel_path"))).drop("_rel_path", "_rel_text", "_rel_path_told", "_rel_text_told")
    return df.withColumn(out, _relevance(F.col("_rel_path"), F.col("_rel_text"), keywords)) \
        .drop("_rel_path", "_rel_text")


def _relevance(path: Column, low: Column, keywords=None) -> Column:
    kws = lit_array(list(keywords or URL_KEYWORDS))
    return _points(F.exists(kws, lambda k: path.contains(k)), F.exists(kws, lambda k: low.contains(k)), path)


def _points(in_path: Column, in_text: Column, path: Column) -> Column:
    slashes = F.length(path) - F.length(F.regexp_replace(path, "/", ""))
    return F.when(in_path, 5).otherwise(0) + F.when(in_text, 3).otherwise(0) + F.greatest(F.lit(0), 3 - slashes)


def crawl_edges(pages: DataFrame, parsed: DataFrame | None = None, keywords=None) -> DataFrame:
    """C1+C2+C3 edge table: every <a href> of every stored page, resolved against the
    page URL, kept when it stays on the page's netloc (raw, case-kept) and scores
    > 0; one row per (src_url, dst_url) with the best (lowest) priority.

    Rows are dropped through the aggregate's output (see links.unique_links)."""
    parsed = parse_pages(pages) if parsed is None else parsed
    ln = page_links(parsed)
    e = with_joined_url(ln, "url", "href", "dst_url").select(F.col("url").alias("src_url"), "dst_url", "text")
    e = with_relevance(e, "dst_url", "text", "score", keywords)
    ok = (url_netloc(F.col("dst_url")) == url_netloc(F.col("src_url"))) & (F.col("score") > 0)
    g = e.groupBy("src_url", "dst_url").agg(F.min(F.when(ok, 100 - F.col("score"))).alias("priority"))
    return g.filter(F.col("priority").isNotNull())


def same_site_unseen(links: DataFrame, visited: DataFrame, identity: str = "raw") -> DataFrame:
    """Distinct (src_url, dst_url) links on the source page's netloc whose URL is not
    yet visited. ``identity``: "raw" compares absolute URLs as they are, "norm" normalized
    ones (of links to the same normalized URL each stays)."""
    same = url_netloc(F.col("dst_url")) == url_netloc(F.col("src_url"))
    g = links.groupBy("src_url", "dst_url").agg(F.max(same).alias("keep")).filter(F.col("keep"))
    if identity == "norm":
        known = visited.select(normalize_url(F.col("url")).alias("_norm")).where("_norm IS NOT NULL").distinct()
        return (g.withColumn("_norm", normalize_url(F.col("dst_url"))).join(known, "_norm", "left_anti")
                .select("src_url", "dst_url"))
    if identity != "raw":
        raise ValueError(f"unknown identity {identity}")
    return g.join(visited.select(F.col("url").alias("dst_url")).distinct(), "dst_url", "left_anti") \
        .select("src_url", "dst_url")


def crawl_bfs(seeds: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """C4: level-synchronous bounded traversal.

    seeds(seed) -> (seed, url, depth, priority): a URL is taken once per seed at
    its smallest depth; its priority is the best (lowest) over the links that
    reach it from the previous level. Every step is written to the shared folder, so the
    engine knows its size in bytes and chooses the join by it.
    """
    seeds = seeds.select(F.col("seed"))
    visited = seeds.select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth"),
                           F.lit(0).alias("priority")).distinct()
    visited = stored(visited, "crawl_seeds")
    frontier, n = visited, visited.count()
    # the edge table is read once per level: materialize it once
    e = stored(edges.select("src_url", "dst_url", "priority"), "crawl_edges")
    for d in range(1, max_depth + 1):
        if n == 0:
            break
        f = frontier.select("seed", F.col("url").alias("src_url"))
        cand = (f.join(e, "src_url")
                .filter(url_netloc(F.col("dst_url")) == url_netloc(F.col("seed")))
                .groupBy("seed", F.col("dst_url").alias("url")).agg(F.min("priority").alias("priority")))
        new = (cand.join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
               .select("seed", "url", F.lit(d).alias("depth"), "priority"))
        new = stored(new, "crawl_level")
        n = new.count()
        visited = visited.unionByName(new)
        frontier = new
    return visited


def crawl_budget(visited: DataFrame, max_pages: int = 50) -> DataFrame:
    """At most ``max_pages`` URLs per seed, by depth, then priority, then URL.
    The row_number filter is planned as a per-partition top-k before the shuffle."""
    w = Window.partitionBy("seed").orderBy("depth", "priority", "url")
    return visited.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_pages)


def visited_dedup(df: DataFrame, col: str = "url") -> DataFrame:
    """Each URL once under URL identity (normalized)."""
    return (df.withColumn("norm_url", normalize_url(F.col(col))).filter(F.col("norm_url").isNotNull())
            .dropDuplicates(["norm_url"]))


def fetch_slots(urls: DataFrame, domain_rate: int = 5, global_rate: int = 10,
                url_col: str = "url") -> DataFrame:
    """Assign each URL a one-second slot so that no domain gets more than
    ``domain_rate`` and no second more than ``global_rate`` requests.

    Level d of a domain holds its URLs ranked d*rate+1 .. (d+1)*rate; level d
    takes ceil(n_d / global_rate) consecutive seconds after all earlier levels.
    Both caps hold by construction. Ranks use the skew-safe numbering, so a
    domain holding most URLs is not sorted on one task.
    """
    from sitesift.operators.ranking import exclusive_prefix_sum, row_number_within

    u = urls.select(F.col(url_col).alias("url"), url_netloc(F.col(url_col)).alias("netloc"))
    r = row_number_within(u, ["netloc"], ["url"], out="dom_rank")
    r = r.withColumn("level", F.floor((F.col("dom_rank") - 1) / domain_rate).cast("long"))

    def starts(levels: DataFrame) -> DataFrame:
        # one row per level: up to (largest domain / domain_rate) rows, summed in blocks
        secs = levels.withColumn("secs", F.ceil(F.col("n") / global_rate).cast("long"))
        return exclusive_prefix_sum(secs, "level", "secs", out="start").select("level", "n", "start")

    # level 0 holds the first URLs of every domain: its start comes with the rank's offsets
    r = row_number_within(r, ["level"], ["netloc", "url"], out="level_rank", per_key=starts)
    return (r.withColumn("slot", F.col("start") + F.floor((F.col("level_rank") - 1) / global_rate).cast("long"))
            .select("url", "netloc", "dom_rank", "level", "slot"))


def rate_audit(log: DataFrame, ts_col: str = "ts", domain_col: str = "domain", period: str = "1 second",
               limit: int = 5) -> DataFrame:
    """(domain, period) pairs with more than ``limit`` requests."""
    return (log.groupBy(F.window(F.col(ts_col), period).alias("w"), F.col(domain_col).alias("domain"))
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > limit)
            .select("domain", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("window_start"),
                    F.unix_seconds(F.col("w.end").cast("timestamp")).alias("window_end"), "n"))
