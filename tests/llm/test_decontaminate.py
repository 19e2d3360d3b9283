import random

import numpy as np

from sitesift.llm import decontaminate as dc
from sitesift.llm.fmindex import FMIndex, suffix_array


def test_suffix_array_sorts_runs():
    rng = np.random.default_rng(0)
    for _ in range(100):
        seq = rng.integers(0, 4, rng.integers(1, 80))
        seq[-1] = 0
        number = np.cumsum(seq == 0) - 1          # separators count as symbols of their own, in order
        keys = [(0, int(number[i])) if seq[i] == 0 else (1, int(seq[i])) for i in range(len(seq))]
        assert suffix_array(seq, 4).tolist() == sorted(range(len(seq)), key=lambda i: keys[i:])


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for k in range(120):
        sigma = int(rng.integers(2, 7))
        seq = np.tile(rng.integers(0, sigma, rng.integers(1, 90)), 1 + k % 3)
        seq[-1] = 0
        phrases = rng.integers(1, sigma, (12, int(rng.integers(1, 5))))
        which, pos = FMIndex(seq, sigma).occurrences(phrases)
        m = phrases.shape[1]
        assert sorted(zip(which.tolist(), pos.tolist())) == sorted(
            (i, j) for i in range(12) for j in range(len(seq) - m + 1) if (seq[j:j + m] == phrases[i]).all())


def plain(text, items, window=10):
    w = dc.words((text or "").encode())
    hit, found = [False] * len(w), set()
    for item, t in items:
        iw = dc.words((t or "").encode())
        for i in range(max(1, len(iw) - window + 1) if iw else 0):
            p = iw[i:i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j:j + len(p)] == p:
                    found.add(item)
                    hit[j:j + len(p)] = [True] * len(p)
    return len(w), sum(hit), len(found), dc.sha_of(list(found)), any(hit)


def _case(rng):
    vocab = [f"{a}{b}" for a in "abcdé" for b in "xyz1"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(24)]
    items += [(24, items[5][1]), (25, None), (26, "?!"), (None, "ax ax"), (27, "AX-ay.Az, b1")]
    docs = [(0, None), (1, ""), (2, "ax"), (3, "ax ay\naz b1 ax AY az_B1")]
    for k in range(4, 60):
        parts = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), (rng.choice(items)[1] or "").upper())
        docs.append((k, rng.choice([" ", " - ", "\n"]).join(parts)))
    return docs + [docs[10]], items


SCHEMAS = ("doc_id long, text string", "item_id long, text string")


def _rows(spark, docs, items):
    found = dc.contamination(spark.createDataFrame(docs, SCHEMAS[0]), spark.createDataFrame(items, SCHEMAS[1]))
    return sorted((r["id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                  for r in dc.digest(found).collect())


def test_against_plain_search(spark, monkeypatch):
    docs, items = _case(random.Random(5))
    named = [(i, t) for i, t in items if i is not None]
    want = sorted((i, *plain(t, named)) for i, t in docs)
    assert _rows(spark, docs, items) == want
    monkeypatch.setattr(dc, "SHARD_WORDS", 50)
    assert _rows(spark, docs, items) == want
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)       # several benchmark blocks
    assert _rows(spark, docs, items) == want


def test_empty_tables(spark):
    docs, items = _case(random.Random(6))
    assert _rows(spark, [], items) == []
    assert all(not r[-1] for r in _rows(spark, docs, []))


def test_policies(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"clean é text. {passage.upper()}! more", "k"), (2, "clean", "k"), (3, None, "k")],
                                 "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, passage)], SCHEMAS[1])
    assert sorted(r["doc_id"] for r in dc.decontaminate(docs, bench).collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, bench, policy="cut").collect()}
    assert cut == {1: "clean é text. ! more", 2: "clean", 3: None}
