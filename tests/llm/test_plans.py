"""Token counts, URL templates, licences, mixing."""

import collections
import math
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from sitesift.llm import licenses, mixing, token_counts, url_templates
from sitesift.llm.common import table
from sitesift.session import scratch_path

MODEL = "piece_bpe_32k.model"


# -- token counts -----------------------------------------------------------

def test_unit_counts_are_those_of_the_library():
    import random
    rng = random.Random(1)
    c = token_counts.Counter(token_counts.tokenizer_path(MODEL))
    assert c.by_unit
    texts = ["".join(rng.choice(" ▁\n\tab the<s></s>é日0 <0x0A>") for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += ["", " ", "  ", "▁", "<unk>", "a" * 5000, "the " * 3000]
    assert c.counts(texts) == [len(c.model.encode(t)) for t in texts]


def test_cache_is_joined_and_extended(spark, monkeypatch):
    path = scratch_path(spark, "test-cache")
    first = [(1, "some text"), (2, "some text"), (3, None), (4, ""), (None, "é " * 10)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in first], "doc_id long, text string, n_tokens long")
    c = token_counts.Counter(token_counts.tokenizer_path(MODEL))
    want = lambda rows: collections.Counter(
        (i, len((t or "").encode()), len(c.model.encode(t or ""))) for i, t in rows)
    got = lambda df: collections.Counter(map(tuple, token_counts.token_counts(df, MODEL, path).collect()))
    cached = lambda: spark.read.schema(token_counts.CACHE_SCHEMA).parquet(path).count()
    assert got(docs) == want(first) and cached() == 3
    more = first + [(7, "new text")]
    assert got(spark.createDataFrame(more, "doc_id long, text string")) == want(more) and cached() == 4
    assert got(docs) == want(first) and cached() == 4          # nothing was missing
    assert got(docs.limit(0)) == {}
    # a stored count is believed, not encoded again
    spark.read.schema(token_counts.CACHE_SCHEMA).parquet(path).selectExpr("key", "n_tokens + 100 AS n_tokens") \
        .write.mode("append").parquet(path)
    assert all(n >= 100 for _, _, n in got(docs))


# -- url templates ----------------------------------------------------------

def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path):
    best = None
    for rule, verdict in url_templates.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return best or (None, None)


def test_parts_and_rules(spark):
    urls = [None, "", "x", "http://", "http://A.ÉxAmple.org/es/1?q#f", "http://example.org/en/1", "http://example.org/en/2",
            "https://a.example.org?x=/es/", "http://notexample.org/es/", "http://com/de/", "http://x.com/de", "HTTP://y.com/fr/é z",
            "http://x.com#a://b/", "a://b://c.com/de/1", "http://org", "http://m.example.org/en/17/\nz", "://x.org/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["id"]: r for r in url_templates.judge(df).collect()}
    for k, u in enumerate(urls):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == (verdict or "allow")
    assert url_templates.judge(df.limit(0)).count() == 0


def test_labelled_templates_are_rejected(spark):
    pages, marks = [], []
    for k in range(40):
        pages += [(f"http://h.net/ads/{k}/x.html", 0), (f"http://h.net/news/{k}", 0), (f"http://g.net/p/{k}", 0)]
        if k < 25:
            marks += [(f"http://h.net/ads/{k}/x.html", 1), (f"http://h.net/news/{k}", 0)]
    pages += [("http://h.net/ads/77/x.html", 0)] * 3 + [("http://h.net/" + "/".join("abcdefghijklmnopq"), 0)]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(pages)], "page_id long, url string")
    got = url_templates.judge(df, spark.createDataFrame(marks, "url string, bad int")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["verdict"] == ("block" if r["path"].startswith("/ads/") else "allow"), r
    ads = {r["template"] for r in got if r["path"].startswith("/ads/")}
    assert ads == {"/ads/{{n}}/x.html"}


def test_similar_branches_merge(spark):
    pages = [f"http://h.net/{b}/{k}" for b in ("red", "blue", "green") for k in range(20)] + ["http://h.net/about"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(pages)], "page_id long, url string")
    names = collections.Counter(r["template"] for r in url_templates.judge(df).collect())
    assert names == {"/~blue/{{n}}": 60, "/about": 1}


def plain_merge(rows, depth):
    """The merge of sibling branches in plain Python: rows (host, tokens, n, bad, good)."""
    merged = [list(t) for _, t, _, _, _ in rows]
    for d in range(depth - 1, -1, -1):
        branches = {}
        for (host, _, n, bad, good), m in zip(rows, merged):
            if len(m) > d:
                x = branches.setdefault((host, "/".join(m[:d]), m[d]), [collections.Counter(), 0, 0])
                x[0]["/".join(m[d + 1:])] += n
                x[1] += bad
                x[2] += good
        groups = {}
        for (host, up, own), (below, b, g) in branches.items():
            below = collections.Counter({k: v for k, v in below.items() if v})
            top = max(((v, k) for k, v in below.items()), default=(0, ""))[1]
            if top:
                side = "bad" if b > g else "good" if g else "none"
                groups.setdefault((host, up, top), []).append((own, sum(below.values()), below, b, g, side))
        moves = {}
        for (host, up, _), own in groups.items():
            heads = {s: min((x for x in own if x[5] == s), key=lambda x: (-x[1], x[0]), default=None) for s in ("bad", "good", "none")}
            known = [s for s in ("bad", "good") if heads[s]]
            lead = known[0] if len(known) == 1 else "none"
            for name, n, below, b, g, side in own:
                h = heads[lead if side == "none" else side]
                if h[0] == name:
                    continue
                r, stat = math.sqrt(h[1] / n), 0.0
                for t in below.keys() | h[2].keys():
                    stat += (r * below[t] - h[2][t] / r) ** 2 / (below[t] + h[2][t])
                free = max(len(below.keys() | h[2].keys()) - 1, 1)
                common = below.keys() & h[2].keys()
                labels, theirs = b + g, h[3] + h[4]
                apart = False
                if labels and theirs:
                    p = (b + h[3]) / (labels + theirs)
                    apart = (b == 0 and h[4] == 0) or (g == 0 and h[3] == 0) or (
                        abs(b / labels - h[3] / theirs) > 1.645 * math.sqrt(p * (1 - p) * (1 / labels + 1 / theirs)))
                if (stat <= free + 3 * math.sqrt(2 * free) and 2 * sum(below[t] for t in common) >= n
                        and 2 * sum(h[2][t] for t in common) >= h[1] and not apart):
                    moves[host, up, name] = moves[host, up, h[0]] = "~" + h[0]
        for (host, *_), m in zip(rows, merged):
            if len(m) > d and (host, "/".join(m[:d]), m[d]) in moves:
                m[d] = moves[host, "/".join(m[:d]), m[d]]
    return sorted((r[0], "/".join(r[1]), "/".join(m)) for r, m in zip(rows, merged))


def test_merge_against_a_plain_tree(spark):
    """Random hosts with noise, missing and contradicting labels."""
    import random
    rng = random.Random(4)
    rows = []
    for h in range(12):
        kinds = [{("x", "{n}"): 40, ("x", "about"): 5, ("y",): 8}, {("x", "{n}"): 9, ("z", "q", "{n}"): 30}, {("a",): 3}]
        for b in range(rng.randrange(2, 9)):
            kind = rng.choice(kinds)
            scale, side = rng.choice([1, 1, 5, 20]), rng.choice(["bad", "good", "mixed", None, None])
            for below, n in kind.items():
                n = max(1, int(n * scale * rng.uniform(0.9, 1.1)))
                bad = rng.randrange(4) if side in ("bad", "mixed") else 0
                good = rng.randrange(4) if side in ("good", "mixed") else 0
                rows.append((f"h{h}", [f"b{b}", *below], n, bad, good))
            if rng.random() < 0.5:
                rows.append((f"h{h}", [f"b{b}", f"stray{rng.randrange(3)}"], 1, 0, 0))
        rows += [(f"h{h}", [leaf], 1, rng.randrange(2), 0) for leaf in ("spam", "login")] + [(f"h{h}", [], 1, 0, 0)]
    df = spark.createDataFrame(rows, "host string, tokens array<string>, n long, bad long, good long")
    got = url_templates.merge_branches(df, 4).collect()
    found = sorted((r["host"], "/".join(r["tokens"]), "/".join(r["merged"])) for r in got)
    assert found == plain_merge(rows, 4)
    assert any("~" in m for _, _, m in found) and not any("~spam" in m or "~login" in m for _, _, m in found)


def test_what_merges_and_what_does_not(spark):
    def templates(urls, marks):
        df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
        rows = url_templates.judge(df, spark.createDataFrame(marks, "url string, bad int")).collect()
        return {r["path"]: (r["template"], r["verdict"]) for r in rows}

    # leaves with nothing below are not alike, whatever their labels
    got = templates(["http://h.net/s/" + x for x in ("spam", "login", "privacy", "pricing")],
                    [("http://h.net/s/spam", 1)] * 20 + [("http://h.net/s/login", 0)] * 20)
    assert {t for t, _ in got.values()} == {"/s/spam", "/s/login", "/s/privacy", "/s/pricing"}
    assert got["/s/spam"][1] == "block" and got["/s/login"][1] == "allow"
    # one stray page among many does not part branches; labels carry over to the unlabelled one,
    # and one whose labels contradict stays by itself
    urls = [f"http://h.net/{b}/{k}" for b in ("ads1", "ads2", "news") for k in range(40)] + ["http://h.net/ads2/odd/page"]
    bad, good = ([(f"http://h.net/{b}/{k}", x) for k in range(25)] for b, x in (("ads1", 1), ("news", 0)))
    got = templates([u for u in urls if "news" not in u], bad)
    assert got["/ads1/3"] == got["/ads2/3"] == ("/~ads1/{{n}}", "block")
    # alike to a bad and to a good branch: it joins neither
    got = templates(urls, bad + good)
    assert {got[f"/{b}/3"] for b in ("ads1", "news")} == {("/ads1/{{n}}", "block"), ("/news/{{n}}", "allow")}
    assert got["/ads2/3"][0] == "/ads2/{{n}}"


# -- licences ---------------------------------------------------------------

def test_sentences_left_out_cannot_reach_the_threshold():
    import random
    rng = random.Random(4)
    t = licenses.Templates()
    assert max(t.idf[x] / n for (_, terms), n in zip(t.rows, t.norms) for x in terms) < licenses.LEAST
    for _ in range(20000):
        k = rng.randrange(len(t.rows))
        own = t.rows[k][1]
        s = set(rng.sample(own, rng.randint(1, len(own)))) | {f"other{i}" for i in range(rng.randint(0, 8))}
        s |= set(rng.sample(sorted(t.idf), rng.randint(0, 3)))
        mass = lambda ts: sum(t.idf.get(x, t.rare) ** 2 for x in ts)
        if mass(s & set(own)) / math.sqrt(mass(s)) / t.norms[k] >= licenses.LEAST:
            assert len(s) > 1 and len(s & set(t.idf)) >= len(s) * t.part


def test_inheritance(spark):
    page = lambda text: f"<p>Some words.</p><p>{text}</p>"
    rows = [("http://a.org/LICENSE", page("Released under the MIT License.")),
            ("http://a.org/x/", page("Licensed under CC BY-NC 4.0.")),
            ("http://a.org/x/y/z.html", page("nothing")), ("http://a.org/x/q", page("All rights reserved.")),
            ("http://a.org/other/w", None), ("http://b.org/x/y", page("nothing")), (None, page("Released under the MIT License.")),
            ("http://a.org/x/y/z.html", page("nothing"))]
    df = spark.createDataFrame([(k, u, h, "e") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, license string")
    got = {r["id"]: (r["own_license"], r["license"], r["inherited_from"], r["hops"]) for r in licenses.scan(df).collect()}
    assert got == {0: ("mit", "mit", None, None), 1: ("cc-by-nc-4.0", "cc-by-nc-4.0", None, None),
                   2: (None, "cc-by-nc-4.0", "/x/", 1), 3: ("proprietary", "proprietary", None, None),
                   4: (None, "mit", "/", 1), 5: (None, None, None, None), 6: ("mit", "mit", None, None),
                   7: (None, "cc-by-nc-4.0", "/x/", 1)}
    assert licenses.scan(df.limit(0)).count() == 0


def test_scan_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    want = collections.Counter(con.sql(licenses.oracle_sql()).fetchall())
    got = collections.Counter(map(tuple, licenses.scan(table(spark, sf, "pages")).collect()))
    assert got == want


def test_scan_plan_is_native(spark):
    plan = licenses.scan(table(spark, "/root/testdata/sf0.001", "pages"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- mixing -----------------------------------------------------------------

def lag_is_below_one(order, weights, since=0):
    """Against the weights as given, in fractions of our own: after every slot."""
    total = sum(Fraction(str(w)) for w in weights.values())
    exact = {k: Fraction(str(w)) / total for k, w in weights.items()}
    top = math.lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * top) for k, w in exact.items()}
    done = dict.fromkeys(weights, 0)
    for t, k in enumerate(order, 1):
        done[k] += 1
        assert all(abs(done[x] * top - whole[x] * t) < top for x in whole)


WEIGHTS = [{"a": 1}, {"a": 1, "b": 1}, {"a": .7, "b": .2, "c": .1}, {f"s{k}": 1 + k % 5 for k in range(23)}, {"a": 1, "b": 1e-5},
           {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": .12, **{f"s{k}": .044 for k in range(20)}}, {f"s{k}": 0.1 + k / 97 for k in range(5)}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_a_period_deviates_by_less_than_a_block(weights):
    slots = mixing.period(mixing.shares(weights), 30_000)
    order = sorted((t, k) for k, ts in slots.items() for t in ts)
    assert [t for t, _ in order] == list(range(len(order)))
    lag_is_below_one([k for _, k in order], weights)


@pytest.mark.parametrize("weights", WEIGHTS[1:])
def test_240000_slots_stay_with_the_given_weights(weights):
    """Slots of all blocks, phase by phase as lanes end: less than one block off within each."""
    total = sum(weights.values())
    blocks = {k: max(1, int(240_000 * w / total * (0.3 if n == 1 else 1))) for n, (k, w) in enumerate(sorted(weights.items()))}
    plan = mixing.phases(blocks, weights)
    ends = [p["base"] for p in plan[1:]] + [sum(blocks.values())]
    emitted = collections.Counter()
    for p, end in zip(plan, ends):
        order = [None] * (end - p["base"])
        for k, (share, done, slots) in p["lanes"].items():
            assert done == emitted[k]
            for j in range(blocks[k] - done):
                t = j // share * p["grid"] + slots[j % share] if j % share < len(slots) else len(order)
                if t >= len(order):
                    break
                assert order[t] is None
                order[t] = k
                emitted[k] += 1
        lag_is_below_one(order, {k: weights[k] for k in p["lanes"]})
    assert emitted == blocks


def plain_mix(counts, weights):
    """Slot by slot: among released blocks the earliest deadline; a new start when a lane ends."""
    left, done, out = dict(counts), collections.Counter(), []
    while left:
        total = sum(Fraction(str(weights[k])) for k in left)
        share, j, t = {k: Fraction(str(weights[k])) / total for k in left}, collections.Counter(), 0
        ended = False
        while not ended:
            free = [(math.ceil((j[k] + 1) / share[k]), k) for k in left if math.floor(j[k] / share[k]) <= t]
            _, k = min(free)
            out.append((k, done[k]))
            done[k] += 1
            j[k] += 1
            t += 1
            if done[k] == counts[k]:
                del left[k]
                ended = True
    return out


def test_mixture_against_slot_by_slot_scheduling(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rows = [(k, s) for s, n in (("a", 260), ("b", 75), ("c", 11), ("zz", 9), (None, 4)) for k in range(n)]
    rows = [(i, s, "x") for i, (_, s) in enumerate(rows)] + [(None, "a", "x"), (0, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_block string")
    weights = {"a": .5, "b": .3, "c": .15, "*": .05}
    got = mixing.mix(df, weights, block=4).collect()
    assert len(got) == len(rows) and got[0]["mix_block"] == "x" and len({r["mix_position"] for r in got}) == len(rows)
    counts = {k: -(-n // 4) for k, n in collections.Counter(r["mix_lane"] for r in got).items()}
    assert counts["*"] == 4
    order = {}
    for r in got:
        order.setdefault(r["mix_slot"], set()).add((r["mix_lane"], r["mix_block_"]))
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] and r["mix_position"] // 4 == r["mix_slot"]
    assert [order[t] for t in range(len(order))] == [{x} for x in plain_mix(counts, weights)]
    again = sorted((r["doc_id"] or -1, r["mix_slot"]) for r in mixing.mix(df.repartition(7), weights, block=4).collect())
    assert again == sorted((r["doc_id"] or -1, r["mix_slot"]) for r in got)
    assert mixing.mix(df.limit(0), weights).count() == 0


def test_rounded_weights_and_null_ids(spark, monkeypatch):
    """Beyond LONGEST weights are rounded, and every lane still gets all its blocks; rows
    without an id are spread by what else they hold."""
    share = mixing.shares({"a": 0.123456789, "b": 1, "c": 1e-9}, 1000)
    assert sum(share.values()) == 1000 and min(share.values()) == 1 and abs(share["a"] - 1000 * 0.123456789 / 1.123456790) < 2
    monkeypatch.setattr(mixing, "BUCKET", 16)
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("t"), "id").alias("text"))
    got = mixing.mix(df, {"a": 0.123456789, "b": 1}, block=2, longest=64)
    assert got.select("mix_position").distinct().count() == 3000 and got.agg(F.max("mix_slot")).first()[0] == 1499
