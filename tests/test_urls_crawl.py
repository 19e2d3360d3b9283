"""URLs (F-D), relevance (F-E), crawl order, rate plan, skew-safe ranks."""

import random
from urllib.parse import urljoin, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitesift.functions.urls import normalize_url, with_joined_url
from sitesift.operators.crawl import crawl_bfs, fetch_slots, with_relevance
from sitesift.operators.ranking import row_number_within

BASE = "http://h.example.com/a/b?q=1#f"
HREFS = ["c", "/c", "../c", "./c", "?z=2", "#t", "", "//o.example.com/p", "https://o.example.com", "a/../d",
         "../../../e", "mailto:x@y.z", "tel:1", "c/./d/", "c/..", "/x/../../y", "g;p?q#f", "..", "."]


def test_url_join_matches_urljoin(spark):
    df = spark.createDataFrame([(BASE, h) for h in HREFS], "base string, href string")
    got = {r.href: r.abs_url for r in with_joined_url(df, "base", "href").collect()}
    for h in HREFS:
        assert got[h] == urljoin(BASE, h), h


def test_normalize_identity(spark):
    df = spark.createDataFrame([("http://Site.com",), ("https://site.com",), ("https://site.com?q=x",), ("tel:1",)], "u string")
    assert [r.n for r in df.select(normalize_url(F.col("u")).alias("n")).collect()] == \
        ["http://site.com"] * 3 + [None]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.from_regex(r"https?://[a-zA-Z0-9.]{1,8}(/[a-zA-Z0-9._~-]{0,6}){0,3}(\?[a-z=]{0,4})?", fullmatch=True),
                min_size=1, max_size=5))
def test_normalize_is_idempotent(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(normalize_url(F.col("u")).alias("n"))
    once = [r.n for r in df.collect()]
    twice = [r.n for r in df.select(normalize_url(F.col("n")).alias("n")).collect()]
    assert once == twice


def test_relevance_fe(spark):
    rows = [("http://h.example.com", "Home", 3), ("http://h.example.com/team", "Our team", 10),
            ("http://h.example.com/x/y", "Read", 1), ("http://h.example.com/x/y/z", "Read", 0),
            ("http://h.example.com/x/y/z", "team page", 3), ("http://h.example.com/a;team", "x", 2)]
    df = spark.createDataFrame(rows, "u string, t string, want int")
    got = with_relevance(df, "u", "t", "s", ["team"]).collect()
    assert [r.s for r in got] == [r.want for r in got]


def _graph(n_sites=3, n_pages=40, seed=1):
    rnd = random.Random(seed)
    edges = []
    for s in range(n_sites):
        host = f"http://t{s}.example.com"
        for i in range(n_pages):
            for _ in range(rnd.randint(0, 6)):
                j = rnd.randrange(n_pages)
                dst = f"{host}/p/{j}" if rnd.random() > 0.1 else f"http://x{s}.example.org/p/{j}"
                edges.append((f"{host}/p/{i}", dst, rnd.randint(89, 99)))
    seeds = [f"http://t{s}.example.com/p/0" for s in range(n_sites)]
    return seeds, edges


def test_bfs_levels(spark):
    edges = [("http://a.x/0", "http://a.x/1", 99), ("http://a.x/0", "http://a.x/2", 95),
             ("http://a.x/1", "http://a.x/2", 90), ("http://a.x/2", "http://a.x/3", 97),
             ("http://a.x/3", "http://a.x/4", 97), ("http://a.x/0", "http://b.x/9", 90)]
    e = spark.createDataFrame(edges, "src_url string, dst_url string, priority int")
    s = spark.createDataFrame([("http://a.x/0",)], "seed string")
    got = {(r.url, r.depth, r.priority) for r in crawl_bfs(s, e, 3).collect()}
    assert got == {("http://a.x/0", 0, 0), ("http://a.x/1", 1, 99), ("http://a.x/2", 1, 95), ("http://a.x/3", 2, 97),
                   ("http://a.x/4", 3, 97)}


def test_row_number_within_matches_window_under_skew(spark):
    rows = [("hot", f"u{i:05d}") for i in range(3000)] + [(f"d{i % 50}", f"v{i:05d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, o string")
    got = row_number_within(df, ["k"], ["o"], out="rn", num_partitions=8)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert sorted(map(tuple, got.select("k", "o", "rn").collect())) == sorted(map(tuple, want.collect()))


def test_fetch_slots_caps_hold_with_a_dominant_domain(spark):
    urls = [f"http://hot.example.com/{i}" for i in range(300)] + \
           [f"http://d{i % 40}.example.com/{i}" for i in range(600)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    s = fetch_slots(df, 5, 10)
    assert s.count() == len(urls)
    assert s.groupBy("netloc", "slot").count().agg(F.max("count")).first()[0] <= 5
    assert s.groupBy("slot").count().agg(F.max("count")).first()[0] <= 10
    # the plan is dense: total seconds = sum over levels of ceil(n_level / 10)
    lv = s.groupBy("level").count().collect()
    assert s.agg(F.max("slot")).first()[0] + 1 == sum((r["count"] + 9) // 10 for r in lv)


def test_bfs_against_plain_levels(spark):
    seeds, edges = _graph(n_sites=2, n_pages=30, seed=7)
    e = spark.createDataFrame(edges, "src_url string, dst_url string, priority int")
    s = spark.createDataFrame([(x,) for x in seeds], "seed string")
    got = {(r.seed, r.url): (r.depth, r.priority) for r in crawl_bfs(s, e, 3).collect()}
    want = {}
    for seed in seeds:
        level, want[seed, seed] = {seed}, (0, 0)
        for d in range(1, 4):
            best = {}
            for src, dst, p in edges:
                if src in level and urlparse(dst).netloc == urlparse(seed).netloc and (seed, dst) not in want:
                    best[dst] = min(p, best.get(dst, p))
            want.update({(seed, u): (d, p) for u, p in best.items()})
            level = set(best)
    assert got == want


def test_url_join_fuzz(spark):
    rnd = random.Random(5)
    bases = ["http://h.example.com/a/b?q=1#f", "https://h.example.com", "http://h.example.com/a/;p",
             "http://h.example.com/a/b;x/c;y?z", " http://h.x/\tq/ "]
    parts = ["/", ".", "..", ";", "?", "#", ":", "a", "b", " ", "\t", "http:", "//", "%", "é", "&", "="]
    hrefs = [" /c", "\n/c\n", "/c\t/d", "//", "///x", "  ", "..;p"] + [
        "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 7))) for _ in range(1500)]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in with_joined_url(df, "b", "h", "j").collect():
        try:
            want = urljoin(r.b, r.h)
        except ValueError:
            continue
        assert r.j == want, (r.b, r.h)


def test_unique_links_take_the_first_link_that_passes(spark):
    from sitesift.operators.links import unique_links
    html = '<a href="/x.css">a</a><a href="/x.css?v=1">b</a><a href="/y">c</a><a href="/y?z">d</a>'
    pages = spark.createDataFrame([(1, "http://h.example.com/", html)], "page_id long, url string, html string")
    assert {(r.pos, r.href) for r in unique_links(pages).collect()} == {(1, "/x.css?v=1"), (2, "/y")}
    only = unique_links(pages, keep=lambda u: u.contains("?")).collect()
    assert {(r.pos, r.href) for r in only} == {(1, "/x.css?v=1"), (3, "/y?z")}
