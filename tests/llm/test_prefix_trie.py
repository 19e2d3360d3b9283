"""Prefix trie against a plain tree: bursts, blocks, copies, ties, nulls."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from sitesift.llm import prefix_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()[:16]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append((c, d == len(seq)))
    out = {}
    for p in sorted(members, key=len, reverse=True):
        ids = [c for c, _ in members[p]]
        below = [q for q in out if len(q) == len(p) + 1 and q[:-1] == p]
        ends = ",".join(str(c) for c in sorted(c for c, e in members[p] if e))
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        out[p] = (min(ids), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(ids), len(below),
                  sum(out[q][5] for q in below) + (not below), sum(out[q][6] for q in below) + (len(ids) - 1) * words,
                  hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("conv", "unit", "rn", "n", "k", "low", "b", "seq", "class", "depth", "path", "head"):
        df = df.withColumn(c, F.lit("x"))
    return df


def got(spark, rows, **more):
    found = prefix_trie.prefix_trie(table_of(spark, rows), **more)
    assert found.columns == NAMES
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_bursting_containers(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 130), 1000, 1007, -3, -20, -41]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, " x\x1cy \n", "é ü ö"])))
    rows += [(5, 0, "user", "tie"), (5, 0, "user", "another"), (5, None, "system", "first"), (5, 0, "user", "tie"),
             (None, 1, "user", "lost"), (9, None, None, None), (9, None, None, None), (60, None, None, "w " * 50_000)]
    want = plain(rows)
    assert got(spark, rows, limit=4) == want
    assert got(spark, rows) == want


def test_long_and_copied_conversations(spark):
    """Sharing over several blocks, copies, an end just at a block's edge, a hot start."""
    rng = random.Random(4)
    long = [("user", f"turn {k} of many") for k in range(200)]
    rows = []
    for c, n in enumerate([200, 200, 64, 65, 128, 130, 63, 200, 129, 192, 200, 1]):
        rows += [(100 * c + 1, k, r, t) for k, (r, t) in enumerate(long[:n])]
    rows += [(5001, k, "user", f"turn {k} of many" if k < 128 else f"own {k}") for k in range(300)]
    for c in range(7000, 7300):          # copies, all below one first turn
        rows += [(c, k, "user", t) for k, t in enumerate(["hot", "hot", "hot", "hot", rng.choice(["end", "other end"])])]
    assert got(spark, rows) == plain(rows)


def test_empty_and_single(spark):
    assert got(spark, [(None, 0, "user", "x")]) == []
    # conversation 1 takes its first turns from the absent conversation 0
    one = [(1, 0, "user", "x")]
    assert got(spark, one) == plain(one) and table_of(spark, one).limit(0).count() == 0
    assert prefix_trie.prefix_trie(table_of(spark, one).limit(0)).collect() == []


def test_id_lists_in_pieces(spark):
    """The digest of a long list that many tasks sort and join."""
    n = 3 * prefix_trie.PIECE + 7
    rows = spark.range(n).select(F.lit(b"k" * 16).alias("k"), F.col("id").alias("conv"))
    rows = rows.unionByName(spark.range(5, 6).select(F.lit(b"a" * 16).alias("k"), F.col("id").alias("conv"))).repartition(7)
    found = {bytes(r["k"]): r["sha"] for r in prefix_trie.id_list_hashes(rows).collect()}
    assert found == {b"k" * 16: hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest(),
                     b"a" * 16: hashlib.sha256(b"5").hexdigest()}
