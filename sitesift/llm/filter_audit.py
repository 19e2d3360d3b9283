"""Filter interaction audit: what each filter of a chain removes in every order.

Every text is read once for its failure flags. A duplicate prepass then spares the
shuffle of unique texts: tasks build counting Bloom sketches (two-bit counters) of the
texts' digests, the sketches merge block by block, and a text with a counter below two is
certainly unique. Only possible repeats are grouped by their full text for the smallest
id. The flags make a mask for each row; counts by mask are additive, so all orders follow
from at most 32 counts a part.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import binary_texts, stored

FILTERS = "ABCDE"
REPEAT = 16                   # the mask's bit for E
BLOCK_BITS = 16               # counters of a block, as a power of two: 16 KB
PER_TEXT = 8                  # counters for each row, as far as MAX_BITS goes
MAX_BITS = 28                 # counters of a sketch at most, as a power of two: 64 MB are broadcast
_UPPER, _TAIL = bytes(range(65, 91)), bytes(range(128, 192))
_SIGNS = (b"#", b"$", b"%", b"&", b"*", b"|")


def mask_of(text: bytes) -> int:
    """Failure flags of filters A to D of a text in UTF-8."""
    words = text.split()
    n = len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _TAIL))
    return ((n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * upper > 5 * points) << 2
            | any(s in text for s in _SIGNS) << 3)


def flagged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per row: id, part, mask of A to D and two digests of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                p = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays(
                    [*p.columns[:4], pa.array([mask_of(t) for t in binary_texts(p, 4)], pa.int32())],
                    names=["id", "part", "h", "h2", "mask"])

    return rows.mapInArrow(run, f"id {kind}, part string, h long, h2 long, mask int")


def slots(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """(k, n) counters of each digest; those of one digest differ."""
    h = h.astype(np.int64).view(np.uint64)
    step = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h + np.arange(k, dtype=np.uint64)[:, None] * step) & np.uint64((1 << bits) - 1)


def partial_sketch(digests: list[np.ndarray], bits: int, k: int):
    """(block, counters at one, counters at two or more) of some digests, for touched blocks."""
    at, n = np.unique(slots(np.concatenate(digests), bits, k), return_counts=True)
    block, low = (at >> np.uint64(BLOCK_BITS)).astype(np.int64), (at & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)
    edges = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(block)]):
        more = n[lo:hi] > 1
        yield int(block[lo]), low[lo:hi][~more].tobytes(), low[lo:hi][more].tobytes()


def pack(counters: np.ndarray) -> bytes:
    """Counters 0 to 2 at two bits each."""
    c = counters.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes()


def merged(stream):
    """(block, packed counters) from partial sketches that come sorted by block."""
    block, counters = None, None
    for b, once, twice in stream:
        if b != block:
            if block is not None:
                yield block, pack(counters)
            block, counters = b, np.zeros(1 << BLOCK_BITS, np.uint8)
        counters[np.frombuffer(once, np.uint16)] += 1
        counters[np.frombuffer(twice, np.uint16)] = 2
        np.minimum(counters, 2, out=counters)
    if block is not None:
        yield block, pack(counters)


def duplicate_sketch(digests: DataFrame, max_bits: int = MAX_BITS):
    """Counting Bloom sketch of a column ``h`` of digests: (bits, k, packed counters).

    The size follows the number of rows up to 2^``max_bits`` counters; beyond, counters
    are shared by more texts, so fewer are cleared, and the exact step has more to do.
    """
    n = digests.count()
    bits = min(max_bits, max(BLOCK_BITS, (PER_TEXT * max(n, 1) - 1).bit_length()))
    k = max(1, min(6, round(0.69 * (1 << bits) / max(n, 1))))

    def build(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            size += b.num_rows
            if size >= 1 << 19:
                yield from rows(held)
                held, size = [], 0
        if size:
            yield from rows(held)

    def rows(held):
        out = list(partial_sketch(held, bits, k))
        for lo in range(0, len(out), 256):
            cols = list(zip(*out[lo:lo + 256]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                                              pa.array(cols[2], pa.binary())], names=["block", "once", "twice"])

    def merge(batches):
        def stream():
            for b in batches:
                for i in range(b.num_rows):
                    yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()
        for block, packed in merged(stream()):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())],
                                             names=["block", "counters"])

    found = (digests.select("h").mapInArrow(build, "block long, once binary, twice binary")
             .repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, counters binary"))
    sketch = np.zeros(1 << (bits - 2), np.uint8)
    size = 1 << (BLOCK_BITS - 2)
    for r in found.toLocalIterator():                 # 2^max_bits counters at two bits: 64 MB at most
        sketch[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["counters"], np.uint8)
    return bits, k, sketch


def may_repeat(h: np.ndarray, bits: int, k: int, sketch: np.ndarray) -> np.ndarray:
    """Whether all counters of a digest are at two: texts for which not are unique."""
    out = np.ones(len(h), bool)
    for at in slots(h, bits, k):
        out &= (sketch[at >> np.uint64(2)] >> ((at & np.uint64(3)) << np.uint64(1)).astype(np.uint8)) & 3 >= 2
    return out


def _sketch_test(spark, sketch) -> Column:
    shared = spark.sparkContext.broadcast(sketch)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(may_repeat(h.to_numpy(), *shared.value))

    return test("h")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, part and the mask of the filters that it fails.

    Null texts are empty, a null part is the empty string. A row with a null id never
    fails E and makes no other row fail; rows with equal ids don't make each other fail.
    """
    spark = docs.sparkSession
    rows = stored(flagged(docs, id_col, text_col, part_col), "audit-flags")
    named = rows.where("id is not null")
    test = _sketch_test(spark, duplicate_sketch(named))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    possible = (docs.where(F.col(id_col).isNotNull())
                .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).where(test))
    # the smallest id of each full text, written so that a hot key on the other side of the join can be split
    first = stored(possible.groupBy("text").agg(F.min("id").alias("id"))
                   .select("id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"),
                           F.lit(True).alias("first")), "audit-first")
    maybe = named.withColumn("maybe", test)
    found = (maybe.where("maybe").join(first, ["id", "h", "h2"], "left")
             .select("id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + REPEAT).alias("mask")))
    rest = maybe.where("not maybe").select("id", "part", "mask")
    return found.unionByName(rest).unionByName(rows.where("id is null").select("id", "part", "mask"))


def counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Additive counts (part, mask, n, good, toxic) of ``masks`` rows. An id labelled more
    than once is good (toxic) if any of its labels says so."""
    marks = stored(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
                   .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"),
                        F.max((F.col("toxic") == 1).cast("long")).alias("toxic")), "audit-labels")
    known = rows.where("id is not null").join(marks, "id", "left").select("part", "mask", "good", "toxic")
    empty = F.lit(None).cast("long")
    known = known.unionByName(rows.where("id is null").select("part", "mask", empty.alias("good"), empty.alias("toxic")))
    return known.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(found: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from additive mask counts."""
    steps = [{"o": "".join(o), "s": s + 1, "f": 1 << FILTERS.index(o[s]), "p": sum(1 << FILTERS.index(c) for c in o[:s])}
             for o in permutations(FILTERS) for s in range(len(FILTERS))]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,f:int,p:int>>")
    cells = (found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
             .select("part", "c", F.explode(plan).alias("t")))      # at most 32 cells a part

    def total(value: str, test: str) -> Column:
        return F.expr(f"aggregate(filter(c, x -> {test}), 0L, (a, x) -> a + {value})")

    removed = "(x.mask & t.p) = 0 and (x.mask & t.f) <> 0"
    orders = 1
    for k in range(2, len(FILTERS) + 1):
        orders *= k
    return cells.select(
        "part", F.col("t.o").alias("filter_order"), F.col("t.s").alias("step"),
        total("x.n", "(x.mask & (t.p | t.f)) = 0").alias("kept"), total("x.n", removed).alias("removed"),
        total("x.n", "(x.mask & t.f) <> 0 and (x.mask & t.p) <> 0").alias("redundant"),
        total("x.n", "x.mask = t.f").alias("unique_fails"), total("x.good", removed).alias("good_lost"),
        total("x.toxic", removed).alias("toxic_lost"),
        # of a row's failing filters each comes first in an equal share of all orders
        total(f"x.n * ({orders} div bit_count(x.mask))", "(x.mask & t.f) <> 0").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """600 rows a part: what every filter keeps, removes and costs at each step of all 120
    orders. See ``masks`` and ``counts`` for nulls and repeated rows; an empty table has no
    parts and gives no rows; other columns are ignored."""
    return audit(counts(masks(docs, id_col, text_col, part_col), labels, id_col))


def oracle_sql() -> str:
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words} AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
m AS (SELECT doc_id, part,
        [CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END,
         CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 1 ELSE 0 END,
         CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 1 ELSE 0 END,
         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END,
         CASE WHEN doc_id > low THEN 1 ELSE 0 END] AS fails FROM w),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT part, fails, list_sum(fails) AS k, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM m LEFT JOIN y USING (doc_id)),
l(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, list_aggregate(list_transform(ord, lambda x: chr(CAST(64 + x AS INTEGER))), 'string_agg', '') AS filter_order,
             l.i AS step FROM o, l),
x AS (SELECT r.part, s.filter_order, s.step, r.good, r.toxic, r.k, r.fails[s.ord[s.step]] AS f,
             coalesce(list_sum(list_transform(s.ord[1:s.step - 1], lambda q: r.fails[q])), 0) AS p FROM r, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN p = 0 AND f = 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN p = 0 AND f = 1 THEN 1 ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN p > 0 AND f = 1 THEN 1 ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN f = 1 AND k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN p = 0 AND f = 1 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN p = 0 AND f = 1 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN f = 1 THEN 120 // k ELSE 0 END) AS BIGINT) AS shapley
FROM x GROUP BY 1, 2, 3
"""
