"""SimHash near-duplicates: exact Hamming search over popcount tiles.

Fingerprints are made in one Arrow pass over whole texts. Distinct fingerprints are
then sorted into tiles by the population counts of ``segments`` slices of the 64
bits. Two fingerprints at distance d differ by at most d in the sum of the absolute
differences of those counts, so only tile pairs within the radius are compared, with
numpy exclusive-or and bit counts. Each tile pair reports a spanning star of the
links it found; components are contracted over the tables of links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import binary_texts, free_name, stored
from sitesift.llm.components import connected_components

TILE = 2048          # fingerprints in one tile at most
STRIP = 1 << 20      # pairs compared at once
CHUNK = 1 << 14      # shingle hashes counted at once


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 bytes: A-Z lower-cased, words between
    ASCII white space, ``shingle``-word shingles with repeats; a bit is 1 if set in
    over half the hashes. Fewer words: the whole sequence is one shingle; none: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    ends = ends[shingle - 1:]
    n, digest, counts = len(ends), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[lo:lo + CHUNK], ends[lo:lo + CHUNK])),
                        np.uint64, min(CHUNK, n - lo))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (id, fp long) per row of ``docs``; null and empty texts give 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = np.fromiter((simhash(t, shingle) for t in binary_texts(b)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _slices(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of the bit slices whose population counts name a tile."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _steps(segments: int, radius: int) -> list[int]:
    """Key differences of tiles within ``radius``, one of each opposite pair, 0 first."""
    found = [()]
    for _ in range(segments):
        found = [v + (d,) for v in found for d in range(-radius, radius + 1)
                 if sum(map(abs, v)) + abs(d) <= radius]
    half = [v for v in found if v > (0,) * segments]
    return [0, *(sum(d << (7 * i) for i, d in enumerate(v)) for v in half)]


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a[i]-b[i] reduced to node-root pairs of their components."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _near(a: np.ndarray, b: np.ndarray, same: bool, radius: int):
    """Pairs of one tile pair within the radius, strip by strip."""
    rows = max(1, STRIP // max(1, len(b)))
    for lo in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[lo:lo + rows, None] ^ b[None, :]) <= radius)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield _star(a[i], b[j])


def _compare(radius: int):
    """Arrow function over rows (a, b, same): blobs of fingerprints of two tiles."""
    def small(rows):
        a = [np.frombuffer(x, np.uint64) for x, _, _ in rows]
        b = [np.frombuffer(y, np.uint64) for _, y, _ in rows]
        na, nb = np.array([len(x) for x in a]), np.array([len(y) for y in b])
        a, b, same = np.concatenate(a), np.concatenate(b), np.array([s for _, _, s in rows])
        pairs = na * nb
        row = np.repeat(np.arange(len(rows)), pairs)
        at = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = at // nb[row], at % nb[row]
        x, y = a[(np.cumsum(na) - na)[row] + i], b[(np.cumsum(nb) - nb)[row] + j]
        hit = (np.bitwise_count(x ^ y) <= radius) & (~same[row] | (i < j))
        if hit.any():
            yield _star(x[hit], y[hit])

    def found(batches):
        for batch in batches:
            queue, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(row[0]) * len(row[1]) // 64
                if n > 4096:
                    yield from _near(np.frombuffer(row[0], np.uint64), np.frombuffer(row[1], np.uint64),
                                     row[2], radius)
                    continue
                queue.append(row)
                size += n
                if size > STRIP // 4:
                    yield from small(queue)
                    queue, size = [], 0
            if queue:
                yield from small(queue)

    def run(batches):
        for u, v in found(batches):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                             names=["u", "v"])
    return run


def _pack(batches):
    """Sorted (tile, fp) rows into tiles of at most TILE fingerprints."""
    seq = 0
    for batch in batches:
        keys, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        out = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            for s in range(lo, hi, TILE):
                out.append((int(keys[lo]), seq, fps[s:min(hi, s + TILE)].tobytes()))
                seq += 1
        if out:
            k, q, f = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(q, pa.int64()),
                                              pa.array(f, pa.binary())], names=["tile", "seq", "fps"])


def links(fps: DataFrame, radius: int = 2, segments: int = 6) -> DataFrame:
    """Links (u, v) that connect all distinct ``fp`` values within ``radius`` bits.

    The tile key holds each slice's count, shifted by the radius, in seven
    bits (``segments`` is 1 to 9; links do not depend on it). A tile's
    rows are sorted before they are cut, so a repeated task cuts the same tiles.
    """
    key = sum((F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(((1 << w) - 1) << s if s + w < 64
              else (((1 << w) - 1) << s) - (1 << 64)))).cast("long") + radius, 7 * i)
              for i, (s, w) in enumerate(_slices(segments))), F.lit(0).cast("long"))
    rows = fps.select("fp").distinct().select(key.alias("tile"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = rows.repartition(n, "tile").sortWithinPartitions("tile", "fp").mapInArrow(
        _pack, "tile long, seq long, fps binary")
    tiles = stored(tiles, "simhash-tiles")
    steps = F.array(*(F.lit(s).cast("long") for s in _steps(segments, radius)))
    left = tiles.select(F.col("tile").alias("own"), F.col("seq").alias("s1"), F.col("fps").alias("a"),
                        F.explode(F.transform(steps, lambda d: F.col("tile") + d)).alias("tile"))
    right = tiles.select("tile", F.col("seq").alias("s2"), F.col("fps").alias("b"))
    pairs = (left.join(right, "tile").where("own <> tile or s1 <= s2")
             .select("a", "b", F.expr("own = tile and s1 = s2").alias("same")))
    return pairs.mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2, segments: int = 6) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), class (smallest fingerprint of the
    component, never null) and component_id (smallest id of the class; null only if all
    its ids are null). Null or empty texts share fingerprint 0; repeated rows stay
    repeated; an empty table gives no rows; other columns are ignored."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    by_fp = stored(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = connected_components(links(by_fp, radius, segments))
    named = (by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "low", F.coalesce("root", "fp").alias("class")))
    lows = named.groupBy("class").agg(F.min("low").alias("component_id"))
    classes = named.select("fp", "class").join(lows, "class")
    return fps.join(classes, "fp").select("id", "fp", "class", "component_id")


FEW = 1 << 21          # keys of dropped documents that are broadcast at most


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, a null id
    only if the class has no other, of equal ids the smallest digest of the text. Rows equal
    in id and text are one document and kept once; rows equal in id alone are different
    ones, and each class decides about its own. All columns are kept as they are."""
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), text.isNull().alias("no_text"),
                   F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    found = stored(near_duplicates(docs.select(key.alias("key"), text.alias("text")), "key", "text", **kw).select("id", "component_id"),
                   "simhash-rows")
    name = free_name(docs, "_key")
    lost = stored(found.where("id <> component_id").select(F.col("id").alias(name)).distinct(), "simhash-lost")
    # up to FEW keys (some 60 bytes each) go to every executor; more meet the documents in a shuffle
    few = lambda t: F.broadcast(t) if t.limit(FEW + 1).count() <= FEW else t
    rest = docs.withColumn(name, key).join(few(lost), name, "left_anti")
    repeated = stored(found.where("id = component_id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                      .select(F.col("id").alias(name)), "simhash-repeats")
    if repeated.isEmpty():
        return rest.select(*docs.columns)
    once = rest.join(few(repeated), name, "left_semi").dropDuplicates([name])
    return rest.join(few(repeated), name, "left_anti").unionByName(once).select(*docs.columns)
