"""Site runs: seeds -> crawl -> extraction -> records (Q3), and the link crawl (Q4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions.urls import is_html_url, normalize_url, url_netloc
from sitesift.operators.aggregate import sparse_records
from sitesift.operators.crawl import crawl_bfs, crawl_budget, crawl_edges
from sitesift.operators.links import link_edges
from sitesift.operators.validate import validate_records
from sitesift.plans.contact import contact_info, parsed_pages, wrapper_info
from sitesift.session import stored
from sitesift.sources.sinks import csv_projection


def site_pages(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of the seeds' sites: a crawl never leaves its netloc, so other pages
    need not be parsed."""
    sites = seeds.select(url_netloc(F.col("seed")).alias("_site")).distinct()
    return pages.join(sites, url_netloc(F.col("url")) == F.col("_site"), "left_semi")


def crawl_pages(seeds: DataFrame, pages: DataFrame, max_depth: int = 3, max_pages: int = 50,
                parsed: DataFrame | None = None) -> DataFrame:
    """C4 + C5: the stored pages a crawl from each seed takes, with seed and depth."""
    own = site_pages(seeds, pages)
    edges = crawl_edges(own, parsed=parsed_pages(own) if parsed is None else parsed)
    taken = crawl_budget(crawl_bfs(seeds, edges, max_depth), max_pages)
    return taken.join(pages.select("page_id", "url"), "url")


def site_mentions(seeds: DataFrame, pages: DataFrame, max_depth: int = 3, max_pages: int = 50,
                  titles=None, fuzzy: bool = True) -> DataFrame:
    """(seed, page_id, url, type, value) of the pages each seed's crawl takes."""
    parsed = parsed_pages(site_pages(seeds, pages), keep=True)
    taken = stored(crawl_pages(seeds, pages, max_depth, max_pages, parsed=parsed)
                   .select("seed", "page_id", "url").distinct(), "crawl_taken")
    # pages are joined on (page_id, url): ids hashed from URLs may collide
    sel = parsed.join(taken.select("page_id", "url").distinct(), ["page_id", "url"], "left_semi")
    mentions = contact_info(pages, titles=titles, fuzzy=fuzzy, parsed=sel)
    return taken.join(mentions, ["page_id", "url"]).select("seed", "page_id", "url", "type", "value")


def site_contacts(seeds: DataFrame, pages: DataFrame, max_depth: int = 3, max_pages: int = 50,
                  titles=None, fuzzy: bool = True, tokens: DataFrame | None = None) -> DataFrame:
    """Q3: validated contact rows (CSV shape) of the pages each seed's crawl takes; a page
    taken by several seeds counts once."""
    mentions = site_mentions(seeds, pages, max_depth, max_pages, titles, fuzzy).drop("seed").distinct()
    records = validate_records(sparse_records(mentions), tokens=tokens, titles=titles)
    return csv_projection(records)


def link_crawl_info(seeds: DataFrame, pages: DataFrame, profile: str = "contextual", titles=None, fuzzy: bool = True,
                    keep: Callable[[Column], Column] = is_html_url) -> DataFrame:
    """Q4 with extraction: (page_id, url, step, type, value) of every page of the link
    closure, by the "contextual" or the "wrapper" profile."""
    reached = stored(link_closure(seeds, pages, keep=keep).select("page_id", "url", "step"), "closure")
    sel = pages.join(reached.select("page_id", "url").distinct(), ["page_id", "url"], "left_semi")
    if profile == "wrapper":
        found = wrapper_info(sel, titles=titles).select("page_id", "url", "type", "value")
    elif profile == "contextual":
        found = contact_info(sel, titles=titles, fuzzy=fuzzy)
    else:
        raise ValueError(f"unknown profile {profile}")
    return reached.join(found, ["page_id", "url"])


PLAIN = 4        # steps taken level by level before chains are doubled
SITE = 128 << 20    # bytes of a site's links that one task may hold
CHUNK = 1 << 16     # links of small sites that are walked together


def link_closure(seeds: DataFrame, pages: DataFrame, max_steps: int | None = None,
                 keep: Callable[[Column], Column] = is_html_url) -> DataFrame:
    """Q4: every stored page reachable from the seeds over unique links (URL
    identity = normalized URL), with the step it was first reached. ``keep`` is the
    predicate on link URLs; ``max_steps`` is an optional explicit limit, off by default.
    See ``reach`` for the number of rounds."""
    pg = pages.select("page_id", "url", normalize_url(F.col("url")).alias("norm_url")) \
        .filter(F.col("norm_url").isNotNull())
    start = seeds.select(normalize_url(F.col("seed")).alias("node")).filter(F.col("node").isNotNull()).distinct()
    # read once per round: the edge list is written once
    ln = stored(link_edges(pages, keep), "closure_links").where("src IS NOT NULL AND dst IS NOT NULL")
    found = reach(start, ln, max_steps)[0]
    return found.withColumnRenamed("node", "norm_url").join(pg, "norm_url")


def reach(start: DataFrame, edges: DataFrame, max_steps: int | None = None) -> tuple[DataFrame, int]:
    """Smallest number of edges (src, dst) from any start (node) to every node that can be
    reached: (node, step), and the number of rounds it took. Edges may repeat.

    Most links stay on their site (netloc): a round brings a site's links and the steps known
    on it together and one task walks the site to its end, however deep; links that leave a
    site carry steps to others for the next round. So there are as many rounds as a shortest
    way changes site, and the rounds end when no step changes. With a site whose links are
    over SITE bytes, all goes by joins (``_reach_joined``); so do ``max_steps`` levels.
    """
    if max_steps is None:
        here = edges.withColumn("site", _site("src"))
        bytes_ = F.sum(F.octet_length("src") + F.octet_length("dst"))
        if (here.groupBy("site").agg(bytes_.alias("n")).agg(F.max("n")).first()[0] or 0) <= SITE:
            return _reach_by_site(start, here)
    return _reach_joined(start, edges.distinct(), max_steps)


def _site(node: str) -> Column:
    """What nodes of one site share: scheme and netloc of a URL (steps don't depend on it)."""
    c = F.col(node)
    return F.when(F.contains(c, F.lit("://")), F.substring_index(c, "/", 3)).otherwise("")


def _reach_by_site(start: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    step = F.lit(None).cast("int")
    links = edges.select("site", "src", "dst", (_site("dst") == F.col("site")).alias("own"), step.alias("step"))
    seen = stored(start.where("node IS NOT NULL").select("node").distinct().withColumn("step", F.lit(0)), "closure_seen")
    changed, rounds = seen, 0
    while not changed.isEmpty():
        rounds += 1
        sites = stored(changed.select(_site("node").alias("site")).distinct(), "closure_sites")
        known = seen.select(_site("node").alias("site"), F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"),
                            F.lit(True).alias("own"), "step")
        rows = links.unionByName(known).join(sites, "site", "left_semi")
        found = stored(rows.repartition("site").sortWithinPartitions("site").mapInArrow(_walk_sites, "node string, step int, own boolean"),
                       "closure_found")
        others = known.join(sites, "site", "left_anti").select(F.col("src").alias("node"), "step")
        seen = found.where("own").select("node", "step").unionByName(others)
        away = found.where("NOT own").groupBy("node").agg(F.min("step").alias("step"))
        if rounds == 1 and found.where("NOT own").isEmpty():
            return seen, rounds
        old = seen.select("node", F.col("step").alias("old"))
        changed = stored(away.join(old, "node", "left").where("old IS NULL OR step < old").select("node", "step"), "closure_step")
        seen = stored(seen.join(changed.select("node"), "node", "left_anti").unionByName(changed), "closure_seen")
    return seen, rounds


def _walk_sites(batches):
    """Rows sorted by site, links (src, dst, own) and known steps (src, step) -> (node, step,
    own): all nodes that are reached over the links of a site, smallest steps first."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def walked(t):
        src, dst, own, step = (t.column(c).combine_chunks() for c in ("src", "dst", "own", "step"))
        link = dst.is_valid()
        froms, tos, starts = src.filter(link), dst.filter(link), src.filter(pc.invert(link))
        both = pa.chunked_array([froms, tos, starts], pa.string()).combine_chunks().dictionary_encode()
        ids, nodes = both.indices.to_numpy(), both.dictionary
        n, m = len(nodes), len(froms)
        a, b, s = ids[:m], ids[m:2 * m], ids[2 * m:]
        held = np.zeros(n, bool)
        held[a] = held[s] = True
        held[b[own.filter(link).to_numpy(zero_copy_only=False)]] = True
        first = [0, *np.cumsum(np.bincount(a, minlength=n)).tolist()]
        to = b[np.argsort(a, kind="stable")].tolist()
        steps, levels = [-1] * n, {}
        for x, k in zip(s.tolist(), step.filter(pc.invert(link)).to_pylist()):
            if steps[x] < 0 or k < steps[x]:
                steps[x] = k
                levels.setdefault(k, []).append(x)
        level, now = 0, []
        while now or levels:
            level = level if now else min(levels)
            more, now = [], now + levels.pop(level, [])
            for x in now:
                if steps[x] == level:
                    for y in to[first[x]:first[x + 1]]:
                        if steps[y] < 0 or steps[y] > level + 1:
                            steps[y] = level + 1
                            more.append(y)
            level, now = level + 1, more
        steps = np.array(steps, np.int32)
        at = np.flatnonzero(steps >= 0)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(at)), pa.array(steps[at]), pa.array(held[at])], names=["node", "step", "own"])

    parts, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if size >= CHUNK:
            # whole sites only: walk what lies before the last site that begins here
            site = b.column("site")
            new = [0] if site[0] != parts[-1].column("site")[-1] else []
            new += (np.flatnonzero(pc.not_equal(site[1:], site[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
            if new:
                parts.append(b.slice(0, new[-1]))
                yield walked(pa.Table.from_batches(parts))
                parts, size, b = [], 0, b.slice(new[-1])
        parts.append(b)
        size += b.num_rows
    if parts:
        yield walked(pa.Table.from_batches(parts))


def _reach_joined(start: DataFrame, edges: DataFrame, max_steps: int | None = None) -> tuple[DataFrame, int]:
    """``reach`` by joins of pages and links alone.

    The first PLAIN steps go level by level. Deeper graphs are chains for the most part
    (paging, "next" links): where a link leads to a page with only one way on besides the
    way back, links to pages reached before set aside, link and way on are joined to a jump.
    Each round joins jumps to jumps of twice the length and follows them from all pages
    reached, so a chain takes rounds logarithmic in its length; everything else goes on
    level by level in the same rounds. A page reached by a detour first is corrected later:
    the rounds end when no step changes, which is when all are smallest.
    """
    seen = stored(start.select("node").distinct().withColumn("step", F.lit(0)), "closure_seen")
    changed, n, rounds = seen, seen.count(), 0
    limit = PLAIN if max_steps is None else max_steps
    while n and rounds < limit:
        rounds += 1
        new = (changed.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
               .join(seen.select("node"), "node", "left_anti").withColumn("step", F.lit(rounds)))
        changed = stored(new, "closure_step")
        n = changed.count()
        seen = stored(seen.unionByName(changed), "closure_seen") if n else seen
    if not n or max_steps is not None:
        return seen, rounds
    # links to pages whose step is settled lead nowhere new
    rest = stored(edges.where("src <> dst").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"),
                  "closure_rest")
    ways = rest.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("low"), F.max("dst").alias("high"))
    ways = stored(ways.where("n <= 2").select(F.col("src").alias("dst"), "n", "low", "high"), "closure_ways")
    on = F.when(F.col("n") == 1, F.when(F.col("low") != F.col("src"), F.col("low"))).when(
        F.col("low") == F.col("src"), F.col("high")).when(F.col("high") == F.col("src"), F.col("low"))
    # a jump leads from the link (src, dst) to the link (last, to) ``size`` links further on
    jumps = stored(rest.join(ways, "dst").select("src", "dst", F.col("dst").alias("last"), on.alias("to"), F.lit(1).alias("size"))
                   .where("to IS NOT NULL"), "closure_jumps")
    more = [rest.select("src", F.col("dst").alias("node"), F.lit(1).alias("cost"))]
    grow = True
    while n:
        rounds += 1
        newest = jumps.select("src", F.col("to").alias("node"), (F.col("size") + 1).alias("cost"))
        steps = _follow(changed, more)
        if grow:
            steps = steps.unionByName(_follow(seen, [newest]))
            more.append(newest)
        best = steps.groupBy("node").agg(F.min("step").alias("step"))
        old = seen.select("node", F.col("step").alias("old"))
        changed = stored(best.join(old, "node", "left").where("old IS NULL OR step < old").select("node", "step"), "closure_step")
        n = changed.count()
        if n:
            seen = stored(seen.join(changed.select("node"), "node", "left_anti").unionByName(changed), "closure_seen")
            if grow:
                ahead = jumps.select(F.col("src").alias("last"), F.col("dst").alias("to"), F.col("last").alias("_last"),
                                     F.col("to").alias("_to"), F.col("size").alias("_size"))
                jumps = stored(jumps.join(ahead, ["last", "to"]).select(
                    "src", "dst", F.col("_last").alias("last"), F.col("_to").alias("to"), (F.col("size") + F.col("_size")).alias("size")),
                    "closure_jumps")
                grow = not jumps.isEmpty()
    return seen, rounds


def _follow(nodes: DataFrame, ways: list[DataFrame]) -> DataFrame:
    """(node, step) one way on from ``nodes``."""
    out = None
    for w in ways:
        found = nodes.withColumnRenamed("node", "src").join(w, "src").select("node", (F.col("step") + F.col("cost")).alias("step"))
        out = found if out is None else out.unionByName(found)
    return out


def _ship_by_value():
    """Pickle this module's code into tasks, so executors need no install of the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
