"""Filter audit against brute force: masks, all orders, sketches of any size."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from sitesift.llm import filter_audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    lowest = {}
    for i, t, _ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append((i, s or "", {f for f, x in zip("ABCDE", [
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            re.search(r"[#$%&*|]", t) is not None, i is not None and i > lowest[t]]) if x}))
    out = {}
    for part in {s for _, s, _ in fails}:
        own = [(i, f) for i, s, f in fails if s == part]
        share = {c: 0 for c in "ABCDE"}
        for o in permutations("ABCDE"):
            for _, f in own:
                for c in o:
                    if c in f:
                        share[c] += 1
                        break
        for o in permutations("ABCDE"):
            for k, c in enumerate(o):
                here = [(i, f) for i, f in own if c in f and not f & set(o[:k])]
                out[part, "".join(o), k + 1] = (
                    sum(not f & set(o[:k + 1]) for _, f in own), len(here),
                    sum(c in f and bool(f & set(o[:k])) for _, f in own), sum(f == {c} for _, f in own),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), share[c])
    return out


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("id", "part", "h", "h2", "mask", "maybe", "first", "n", "good", "block", "c", "t"):
        df = df.withColumn(c, F.lit("x"))
    return df


def corpus():
    rng = random.Random(5)
    vocabulary = ["word", "Thing", "LOUD", "x#", "a|b", "é", "ÀÉ", "und", "so", "on", "İ", "1"] + [f"w{k}" for k in range(90)]
    texts = [" ".join(rng.choices(vocabulary[rng.randrange(8):], k=rng.choice([3, 49, 50, 51, 120]))) for _ in range(60)]
    texts += ["", None, " \n\t", "\x1c\x1d", "word word " * 60, "A" * 40_000, "w " * 60_000]
    rows = [(k, rng.choice(texts), rng.choice(["s0", "s1", None, ""])) for k in range(300)]
    rows += [(None, texts[0], "s0"), (None, None, None), (7, texts[1], "s1"), (7, texts[1], "s1"), (7, texts[2], "s1"), (-4, texts[3], "s9")]
    rows += [(1000 + k, "the same text", "s0") for k in range(200)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 2)]
    return rows, labels + [(None, 1, 1), (7, 0, 0), (7, 1, 1), (7, 1, 0)]


def test_against_brute_force(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(table_of(spark, rows), marks).collect()
    want = plain(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in got} == want
    assert len(got) == len(want) == 600 * 4


def test_empty_tables(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = table_of(spark, rows)
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0
    got = filter_audit.filter_audit(docs, marks.limit(0))
    assert got.count() == 2400 and got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_sketch_never_clears_a_repeat(spark):
    rng = np.random.default_rng(1)
    once, twice = rng.integers(-2**63, 2**63 - 1, 20_000), rng.integers(-2**63, 2**63 - 1, 500)
    h = np.concatenate([once, twice, twice])
    rng.shuffle(h)
    digests = spark.createDataFrame([(int(x),) for x in h], "h long")
    sketch = filter_audit.duplicate_sketch(digests)
    assert filter_audit.may_repeat(twice, *sketch).all()
    assert filter_audit.may_repeat(once, *sketch).mean() < 0.06      # most unique ones are cleared
    crowded = filter_audit.duplicate_sketch(digests, max_bits=16)    # three counters a text clear fewer, none wrongly
    assert crowded[2].size == 1 << 14 and filter_audit.may_repeat(twice, *crowded).all()
    assert 0.06 < filter_audit.may_repeat(once, *crowded).mean() < 0.6
