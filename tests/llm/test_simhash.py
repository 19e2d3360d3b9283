import random

import numpy as np
import pytest
import xxhash

from sitesift.llm import simhash
from sitesift.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    """Smallest id reachable, by comparing all pairs."""
    ids = list(fps)
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= radius and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_fingerprint_matches_plain_code():
    rng = random.Random(1)
    texts = ["", " \t\n", "one", "One two", "A b C", "x " * 40, "é à b c\x1cd e", "w" * 3000]
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for t in texts:
        assert simhash.simhash(t.encode()) == plain_fingerprint(t)


def test_long_text_is_counted_in_pieces(monkeypatch):
    t = " ".join(str(i * i % 977) for i in range(5000))
    whole = simhash.simhash(t.encode())
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.simhash(t.encode()) == whole == plain_fingerprint(t)


@pytest.mark.parametrize("segments", [1, 4, 6, 8])
def test_links_connect_what_all_pairs_connect(spark, segments):
    rng = random.Random(segments)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {0, (1 << 64) - 1}
    for b in base:
        fps.add(b)
        for _ in range(6):
            for _ in range(rng.randint(1, 3)):
                b ^= 1 << rng.randrange(64)
            fps.add(b)
    signed = {i: f for i, f in enumerate(sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist()))}
    df = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    root = {r["node"]: r["root"] for r in connected_components(simhash.links(df, 2, segments)).collect()}
    low = plain_components({i: f & (2 ** 64 - 1) for i, f in signed.items()})
    for i, f in signed.items():
        assert root.get(f, f) == signed[low[i]]


def test_small_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 2)
    fps = [1 << k for k in range(12)]           # one tile key per slice, all two bits apart
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert {r["root"] for r in connected_components(simhash.links(df)).collect()} == {1}


def test_near_duplicates_of_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = [(0, None), (1, ""), (2, "  "), (3, "a b c"), (4, "A  b\nc"), (5, "a b")]
    for k in range(15):
        text = [rng.choice(words) for _ in range(400)]
        for _ in range(4):
            rows.append((len(rows), " ".join(text)))
            text[rng.randrange(400)] = rng.choice(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["fp"] & (2 ** 64 - 1), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    low = plain_components(fps)
    assert got == {i: (fps[i], low[i]) for i in fps}
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == sorted(set(low.values()))


def test_components_of_a_chain_and_no_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(None, 1), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(61)}
    assert connected_components(chain.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    """By row, not by id: repeated and null ids, equal rows, other columns kept."""
    near = "one two three four five six seven eight nine ten " * 30
    rows = [(1, near, "a"), (1, near.replace("one two", "one  two", 1), "b"), (1, "something else entirely here", "c"), (2, near, "d"),
            (None, near, "e"), (None, "only without an id", "f"), (None, "only without an id", "g"), (5, "own text of five words", "h"),
            (5, "own text of five words", "h"), (7, None, "i"), (6, "", "j"), (None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    found = simhash.near_duplicates(df).collect()
    assert len({r["class"] for r in found}) == got.count() == 5
    kept = [(r["doc_id"], r["_key"]) for r in got.collect()]
    assert sum(k in ("a", "b") for _, k in kept) == 1 and sum(k in "fg" for _, k in kept) == 1
    assert {(1, "c"), (5, "h"), (6, "j")} <= set(kept)
    assert simhash.keep_one(df.limit(0)).count() == 0
