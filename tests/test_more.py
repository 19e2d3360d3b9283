"""Deep closures, failing extractors, SQL table functions, stateful streams."""

import random

from pyspark.sql import functions as F

from sitesift.session import scratch_path


def plain_steps(start, edges):
    out = {s: 0 for s in start}
    level = list(start)
    ways = {}
    for a, b in edges:
        ways.setdefault(a, set()).add(b)
    while level:
        level = [b for a in level for b in ways.get(a, ()) if b not in out and not out.update({b: out[a] + 1})]
    return out


def reached(spark, start, edges, **kw):
    from sitesift.plans.site import reach
    s = spark.createDataFrame([(x,) for x in start], "node string")
    e = spark.createDataFrame(edges, "src string, dst string").distinct()
    found, rounds = reach(s, e, **kw)
    rows = [(r["node"], r["step"]) for r in found.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows), rounds


def test_chain_of_5000_pages_in_few_rounds(spark):
    n = 5000
    edges = [(f"p{k}", f"p{k + 1}") for k in range(n - 1)] + [(f"p{k + 1}", f"p{k}") for k in range(n - 1)] + [(f"p{k}", "p0") for k in range(1, n)]
    got, rounds = reached(spark, ["p0"], edges)
    assert got == {f"p{k}": k for k in range(n)} and rounds < 20


def test_closure_of_mixed_graphs(spark):
    """Chains with short cuts, rings, detours found first, branches, several starts."""
    rng = random.Random(3)
    edges = []
    for c in range(4):
        m = 60 + 20 * c
        edges += [(f"{c}.{k}", f"{c}.{k + 1}") for k in range(m)]
        edges += [(f"{c}.{rng.randrange(m)}", f"{rng.randrange(4)}.{rng.randrange(60)}") for _ in range(6)]
        edges += [(f"{c}.{m}", f"{c}.{m // 2}"), (f"{c}.5", f"{c}.5")]
    edges += [("s", "0.0"), ("0.40", "1.0"), ("t", "2.30"), ("x", "y")]
    for start in (["s"], ["s", "t"], ["x"], ["nowhere"]):
        got, _ = reached(spark, start, edges)
        assert got == plain_steps(start, edges)
    got, rounds = reached(spark, ["s"], edges, max_steps=7)
    assert rounds == 7 and got == {k: v for k, v in plain_steps(["s"], edges).items() if v <= 7}


def test_sites_are_walked_to_their_end_in_a_round(spark, monkeypatch):
    """Deep sites took a dozen rounds, each of which read every link and jump anew."""
    from sitesift.plans import site as S

    n, rng = 600, random.Random(5)
    edges = []
    for s in range(3):
        p = f"http://s{s}.example.com/p/"
        edges += [(f"{p}{k}", f"{p}{k + 1}") for k in range(n)] + [(f"{p}{k + 1}", f"{p}{k}") for k in range(n)] + [(f"{p}{k}", f"{p}0") for k in range(n)]
    edges += [("http://s0.example.com/p/500", "http://s1.example.com/p/200"), ("http://s1.example.com/p/550", "http://s0.example.com/p/560"),
              ("http://s1.example.com/p/5", "http://t.example.com"), ("plain", "http://s0.example.com/p/300")] + edges[:50]
    monkeypatch.setattr(S, "CHUNK", 1000)
    start = ["http://s0.example.com/p/0", "plain"]
    got, rounds = reached(spark, start, edges)
    assert got == plain_steps(start, edges) and rounds <= 5
    for _ in range(2):                           # ways that go to and fro between sites
        some = [(f"http://h{rng.randrange(6)}/{rng.randrange(25)}", f"http://h{rng.randrange(6)}/{rng.randrange(25)}") for _ in range(260)]
        assert reached(spark, [some[0][0]], some)[0] == plain_steps([some[0][0]], some)
    monkeypatch.setattr(S, "SITE", 1000)         # a site too large for a task: by joins
    assert reached(spark, [some[0][0]], some)[0] == plain_steps([some[0][0]], some)


def test_edges_are_the_unique_links(spark):
    """Plainly written links are put together without the general expressions."""
    from sitesift.functions.urls import normalize_url
    from sitesift.operators.links import link_edges, unique_links

    hrefs = ["/", "/a", "/A/b.html", "/a/", "/a//b", "//h.org/x", "/.", "/..", "/a/../b", "/a/.x", "/a/./", "/a;p", "/a/b;p=1", "/a?q=1", "/a#f", "/x.css", "/x.PDF",
             "http://Other.example.com", "http://o.example.com/", "https://o.example.com:80/A/../b", "http://o.example.com/a.css", "http://o.example.com//a", "HTTP://x/y",
             "http://", "http:///a", "http://o/a;b", "http://o/a?b", "https:/a", "mailto:a@b.c", "", " /a", "/a b", "/a\tb", "/a\n", "/é", "a", "a/b", "../a", "?q", "#f", "ftp://h/x",
             "javascript:void(0)", "/a:b@c", "http://u@h/x", "http://h\n/x", "/%7Ea", "/..a", "/a.b/c", "/mailto:x", "http://h.org/x.json", "/https://k/l", "/a/http://k/l", "http://o.example.com/a://b"]
    bases = ["http://a.example.com/d/e", "https://A.example.com:8080", "http://a.example.com/d?q", "http://a.example.com/#f", "a/b", "", None, "http://a\n/b", "file:///x/y",
             "http://a.example.com/d;p/e", "HTTP://A/b", "http://u@h/x", "http://a/é", "http://a/x #y", "http://a.example.com/d/e\n", "news:x"]
    pages = spark.createDataFrame([(i * 100 + j, b, f'<a href="{h}">x</a> <a href="{h}">') for i, b in enumerate(bases) for j, h in enumerate(hrefs)],
                                  "page_id long, url string, html string")
    for keep in ({}, {"keep": lambda u: F.contains(u, F.lit("example"))}):
        want = unique_links(pages, **keep).select(normalize_url(F.col("url")).alias("src"), F.col("norm_url").alias("dst")).distinct()
        got = link_edges(pages, **keep).where("dst IS NOT NULL").distinct()
        rows = [sorted((tuple(r) for r in x.collect()), key=str) for x in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) > 100


def test_failing_extractor_gives_warnings(spark):
    from sitesift.functions.text import emails_in
    from sitesift.operators.extract import ExtractorRegistry, extraction_problems
    from sitesift.sources.sinks import page_status

    def odd(text):
        if "bad" in text:
            raise KeyError("bad")
        return [text[:2], None, 3] if "none" not in text else None

    reg = ExtractorRegistry().register("email", emails_in).register_plain("odd", odd).register_plain("x", lambda t: t.split())
    rows = [(1, "u1", "good a@b.org"), (2, "u2", "bad c@d.org"), (3, "u3", "no"), (4, "u4", None), (5, "u5", "none"), (2, "u2", "bad c@d.org")]
    df = spark.createDataFrame(rows, "page_id long, url string, text string")
    found = reg.extract_safely(df, names=["email", "odd", "missing"]).cache()
    got = sorted(((r["page_id"], r["type"], r["value"], r["message"]) for r in found.collect()), key=str)
    warning = "extractor odd failed: KeyError: 'bad'"
    assert got == sorted([(1, "email", "a@b.org", None), (1, "odd", "go", None), (2, "email", "c@d.org", None), (2, "email", "c@d.org", None),
                          (2, "odd", None, warning), (2, "odd", None, warning)], key=str)
    pages = df.select("page_id", "url", F.lit("<p>").alias("html")).distinct()
    st = page_status(pages, found.where("value is not null").select("page_id", "url", "type", "value"), extraction_problems(found))
    by = {r["page_id"]: (r["status"], r["warnings"]) for r in st.collect()}
    assert by[2] == ("success", [warning, warning]) and by[1] == ("success", [])
    assert reg.extract_safely(df.limit(0)).collect() == [] and reg.names() == ["email", "odd", "x"]
    reg.register("odd", emails_in)             # replaces the Python one
    assert reg.names() == ["email", "odd", "x"] and reg.extract_safely(df, names=["odd"]).where("level is not null").count() == 0
    found.unpersist()


def test_table_functions(spark):
    from sitesift.functions.tables import register_table_functions
    from sitesift.operators import structure as S
    from sitesift.operators.htmltree import parse_pages

    register_table_functions(spark)
    htmls = ['<div id="a"><p>x <b>y</b></p><a href="/l">go</a></div>', "", None, "<p>a<![ x>", "<p>\n</p>z"]
    pages = spark.createDataFrame([(k, f"u{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    pages.createOrReplaceTempView("some_pages")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    parsed = parse_pages(pages)
    cols = ["page_id", "node_id", "parent_id", "sib_idx", "next_sib", "last_desc", "tag", "attrs"]
    assert rows(spark.sql(f"SELECT {', '.join(cols)} FROM some_pages, LATERAL html_elements(html)")) == rows(S.element_rows(parsed).select(*cols))
    assert rows(spark.sql("SELECT page_id, t.* FROM some_pages, LATERAL html_texts(html) t")) == rows(S.text_nodes(parsed).select("page_id", "pos", "node_id", "text"))
    assert rows(spark.sql("SELECT page_id, l.* FROM some_pages, LATERAL html_links(html) l")) == rows(S.links(parsed).select("page_id", "node_id", "text", "href"))


def test_revisits_drop_their_state(spark):
    from sitesift.streaming.jobs import stream_revisits

    folder, day = scratch_path(spark, "visits"), 86_400
    files = [[(f"u{k}", day + 100 * k) for k in range(50)], [("u0", day + 5000), ("u49", day + 5000), ("u49", day + 8600), ("u49", day + 12_201)], [("u3", 10 * day)], [("u3", 20 * day), ("u0", 20 * day)], [("v", 30 * day)]]
    want, last = [], {}
    for rows in files:
        for u, t in rows:
            if u not in last or t - last[u] > 3600:
                want.append((u, t))
            last[u] = t
    out, states = scratch_path(spark, "visits-out"), []
    for k, rows in enumerate(files):           # the query is started anew for every file
        df = spark.createDataFrame(rows, "url string, t long").select("url", F.timestamp_seconds("t").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/events")
        found, q = stream_revisits(spark, folder, out, delay="1 second")
        states += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert sorted((r["url"], int(r["ts"].timestamp())) for r in found.collect()) == sorted(want)
    assert max(states) >= 50 and states[-1] <= 3      # expired, not kept for ever


def test_url_queue_goes_on_after_a_restart(spark):
    from sitesift.streaming.jobs import stream_url_queue

    base = "http://a.example.com/"
    link = lambda *to: "".join(f'<a href="{x}">team {x}</a>' for x in to)
    files = [[(1, base, link("/a", "/b", "/b", "http://other.org/x", "/x/y/z.pdf"), 0)],
             [(2, base + "a", link("/c", "/b", "/"), 1), (3, base + "c", "", 2)],
             [(4, base + "b", link("/d", "/a") + "<![ x>", 1), (5, base + "e", link("/f"), 1)]]
    folder, out, known, want = scratch_path(spark, "queue"), scratch_path(spark, "queue-out"), set(), {}
    from sitesift.operators.crawl import crawl_edges
    for rows in files:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string, depth int")
        pages.coalesce(1).write.mode("append").parquet(f"{folder}/pages")
        depth = {u: d for _, u, _, d in rows}
        edges = crawl_edges(pages.select("page_id", "url", "html")).collect()
        arrived = known | set(depth)
        for u in {e["dst_url"] for e in edges} - arrived:
            own = [e for e in edges if e["dst_url"] == u]
            want[u] = (min(e["priority"] for e in own), min(depth[e["src_url"]] + 1 for e in own))
        known = arrived | set(want)
        found, q = stream_url_queue(spark, folder, out)
    got = [(r["url"], (r["priority"], r["depth"])) for r in found.collect()]
    assert dict(got) == want and len(got) == len(want) and base + "b" in want and base + "c" not in want


def test_text_separator_and_link_identity(spark, pages_of):
    from sitesift.operators.crawl import same_site_unseen
    from sitesift.operators.htmltree import parse_pages
    from sitesift.operators.structure import page_text

    parsed = parse_pages(pages_of("<p>a <b>b</b></p><p>c</p>", ""))
    assert [r["text"] for r in page_text(parsed, " | ").orderBy("page_id").collect()] == ["a  | b | c", ""]
    assert [r["text"] for r in page_text(parsed).orderBy("page_id").collect()] == ["a bc", ""]
    links = spark.createDataFrame([("http://A.org/", u) for u in ("http://A.org/x?q", "http://A.org/y", "http://b.org/x", "http://A.org/x")], "src_url string, dst_url string")
    visited = spark.createDataFrame([("https://a.org/x",), (None,), ("http://A.org/y",)], "url string")
    left = lambda how: {r["dst_url"] for r in same_site_unseen(links, visited, how).collect()}
    assert left("raw") == {"http://A.org/x?q", "http://A.org/x"} and left("norm") == set()


def test_small_tables_become_pages_in_many_tasks(spark, tmp_path):
    """A table of few bytes is one split; its rows are dealt out before they become pages."""
    from sitesift.plans.generated import contact_pages, link_pages

    rows = spark.range(200).selectExpr("id AS c_custkey", "'Customer' || id AS c_name", "id % 3 AS c_nationkey", "'BUILDING' AS c_mktsegment")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).selectExpr("id AS n_nationkey", "'N' || id AS n_name").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    set_ = spark.conf.get("sitesift.read.partitions")
    spark.conf.unset("sitesift.read.partitions")
    try:
        for pages in (contact_pages(spark, str(tmp_path)), link_pages(spark, str(tmp_path))):
            found = pages.selectExpr("page_id", "spark_partition_id() AS p").collect()
            assert sorted(r.page_id for r in found) == list(range(200))
            assert len({r.p for r in found}) >= 3 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("sitesift.read.partitions", set_)


def test_url_queue_calls_no_function_per_url(spark):
    """The known URLs meet a batch in a join: no Python call and no state row for each URL."""
    from sitesift.streaming.jobs import stream_url_queue

    folder = scratch_path(spark, "queue")
    html = "".join(f'<a href="/p/{i}">team</a>' for i in range(300))
    pages = spark.createDataFrame([(1, "http://a.example.com/", html), (2, "http://a.example.com/p/1", html)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{folder}/pages")
    found, q = stream_url_queue(spark, folder)
    assert sorted(r["url"] for r in found.collect()) == sorted(f"http://a.example.com/p/{i}" for i in range(300) if i != 1)
    assert not any(p["stateOperators"] for p in q.recentProgress)


def test_deep_pages_are_dealt_out(spark):
    from sitesift.plans.more_checks import deep_pages

    folder = scratch_path(spark, "orders")
    spark.range(20, 5020).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    pages = deep_pages(spark, folder)
    assert pages.rdd.getNumPartitions() > 1 and pages.count() == 5000
    assert pages.where("page_id = 4999").first()["url"] == "http://s0.example.com/p/4999"


def test_revisits_take_one_call_for_many_urls(spark, monkeypatch):
    from sitesift.streaming import jobs

    monkeypatch.setattr(jobs, "BUCKETS", 7)
    rng = random.Random(4)
    folder, out = scratch_path(spark, "many-visits"), scratch_path(spark, "many-visits-out")
    want, last, late, states = [], {}, -1, []
    for k in range(4):
        rows = [(f"u{rng.randrange(300)}", 3000 * k + rng.randrange(5000)) for _ in range(900)]
        spark.createDataFrame(rows, "url string, t long").select("url", F.timestamp_seconds("t").alias("ts")) \
            .coalesce(1).write.mode("append").parquet(f"{folder}/events")
        for u, t in sorted(r for r in rows if r[1] > late):
            if u not in last or t - last[u] > 600:
                want.append((u, t))
            last[u] = max(t, last.get(u, t))
        late = max(late, max(t for _, t in rows) - 1000)
        found, q = jobs.stream_revisits(spark, folder, out, ttl_seconds=600, delay="1000 seconds")
        states += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert sorted((r["url"], int(r["ts"].timestamp())) for r in found.collect()) == sorted(want)
    assert max(states) <= 7


def test_contact_rows_are_dealt_out_as_they_are_read(spark, tmp_path):
    """The task that reads the one split makes no text: only columns of the table are shuffled."""
    from sitesift.plans.generated import contact_pages

    spark.createDataFrame([(k, f"C{k}", k % 2, "BUILDING") for k in [1, 2, 2, 3]] + [(4, "C4", None, "MACHINERY"), (None, "C5", 0, None)],
                          "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "N0"), (1, "N1")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    pages = contact_pages(spark, str(tmp_path))
    plan = pages._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("Repartition"):
        plan = plan.children().apply(0)
    assert [plan.output().apply(i).name() for i in range(plan.output().size())] == ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    rows = pages.orderBy("page_id").collect()
    assert [r["page_id"] for r in rows] == [None, 1, 2, 2, 3]
    assert rows[0]["html"] is None and "C1" in rows[1]["html"] and "Org N0" in rows[2]["html"]
