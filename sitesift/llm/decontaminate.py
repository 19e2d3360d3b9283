"""Benchmark decontamination: FM-index per training shard.

Each task cuts its documents into shards of bounded size and indexes the words of each
one. The words of no benchmark phrase cannot be part of an occurrence: they become the
separators of the indexed text, and runs shorter than the shortest phrase are left out.
Phrases are searched backward through wavelet-tree ranks, occurrences located by
sampled suffix positions, and overlapping occurrences merged into removal spans.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import binary_texts, free_name
from sitesift.llm.fmindex import FMIndex

WINDOW = 10               # words in a phrase
SHARD_WORDS = 1 << 19     # words indexed at once (a longer document is its own shard)
BLOCK_BYTES = 1 << 20     # benchmark text searched in one pass over the documents

# A-Z to lower case; everything but 0-9, a-z and bytes over 7F to a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """Distinct windows of a block of benchmark items, as word numbers from 1."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        owners: dict[tuple, set] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(tuple(w[i:i + window]), set()).add(item)
        self.ids = {}
        for phrase in owners:
            for w in phrase:
                self.ids.setdefault(w, len(self.ids) + 1)
        by_length: dict[int, list] = {}
        for phrase, of in owners.items():
            by_length.setdefault(len(phrase), []).append((phrase, of))
        self.items = sorted({i for of in owners.values() for i in of}, key=str)
        number = {item: k for k, item in enumerate(self.items)}
        # per length: symbols (m x length), and the items of each phrase as a flat list
        self.groups = []
        for length, found in sorted(by_length.items()):
            symbols = np.array([[self.ids[w] for w in p] for p, _ in found], np.int64)
            of = [sorted(number[i] for i in s) for _, s in found]
            self.groups.append((length, symbols, np.cumsum([0, *map(len, of)]), np.concatenate(of)))
        self.shortest = min(by_length, default=0)


class _Numbers(dict):
    def __missing__(self, key):
        return 0


def scan_shard(texts: list[list[bytes]], phrases: Phrases, numbers: dict):
    """(hit flags of all words in order, (document, item) pairs) of one shard."""
    lengths = np.array([len(w) for w in texts], np.int64)
    total = int(lengths.sum())
    hit = np.zeros(total, bool)
    pairs = np.zeros((0, 2), np.int64)
    if not total or not phrases.groups:
        return hit, pairs
    get = numbers.__getitem__
    seq = np.empty(total + len(texts), np.int64)
    at = 0
    for w in texts:
        seq[at:at + len(w)] = np.fromiter(map(get, w), np.int64, len(w))
        seq[at + len(w)] = 0
        at += len(w) + 1
    source = np.arange(len(seq)) - np.repeat(np.arange(len(texts)), lengths + 1)   # word number; separators share one
    seps = np.flatnonzero(seq == 0)
    run = np.diff(np.concatenate([[-1], seps])) - 1            # words before each separator
    long = run >= phrases.shortest
    keep = np.zeros(len(seq), bool)
    keep[seps[long]] = True
    keep |= (seq > 0) & np.repeat(long, run + 1)
    text, source = seq[keep], source[keep]
    if not len(text):
        return hit, pairs
    index = FMIndex(text, len(phrases.ids) + 1)
    doc_of = np.repeat(np.arange(len(texts)), lengths)
    cover = np.zeros(total + 1, np.int64)
    found = []
    for length, symbols, first, owner in phrases.groups:
        which, pos = index.occurrences(symbols)
        if not len(which):
            continue
        word = source[pos]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + length, -1)
        some = np.unique(doc_of[word] * len(symbols) + which)
        doc, which = some // len(symbols), some % len(symbols)
        n = first[which + 1] - first[which]
        item = owner[np.repeat(first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        found.append(np.stack([np.repeat(doc, n), item], axis=1))
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
    return np.cumsum(cover[:-1]) > 0, pairs


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def shards(texts: list[bytes]):
    """(first, words of each document) pieces of a batch, of bounded size."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        w = words(t)
        if part and size + len(w) > SHARD_WORDS:
            yield first, part
            first, part, size = i, [], 0
        part.append(w)
        size += len(w)
    if part:
        yield first, part


def judge(texts: list[bytes], phrases: Phrases, numbers: dict):
    """Per document: number of words, merged word spans, and items found."""
    for _, part in shards(texts):
        hit, pairs = scan_shard(part, phrases, numbers)
        ends = np.cumsum([len(w) for w in part])
        cut = np.searchsorted(pairs[:, 0], np.arange(len(part) + 1))
        for k, w in enumerate(part):
            own = hit[ends[k] - len(w):ends[k]]
            yield len(w), (_spans(own) if own.any() else []), pairs[cut[k]:cut[k + 1], 1].tolist()


def block_count(benchmark: DataFrame, text_col: str) -> int:
    size = benchmark.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(1, math.ceil(size / BLOCK_BYTES))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, n: int):
    """The benchmark as ``n`` ``Phrases`` of bounded size, one after another. The driver
    holds one block at a time, whatever the size of the table."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")) \
        .where("text is not null")
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield Phrases([(r[0], bytes(r[1])) for r in part.collect()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (array of word start, end) and
    items (strings, sorted) whose windows occur.

    Null and empty texts have no words; an empty benchmark or one without words hits
    nothing; items with a null id are ignored; repeated items count once; other columns
    are ignored. A benchmark over BLOCK_BYTES is searched block by block and the
    blocks' results are merged by id and digest of the text.
    """
    spark = docs.sparkSession
    named = benchmark.where(F.col(item_col).isNotNull())
    n = block_count(named, item_text_col)
    text = F.col(text_col).cast("string")
    key = F.md5(F.coalesce(text, F.lit(""))) if n > 1 else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = []
    for phrases in blocks(named, item_col, item_text_col, window, n):
        shared = spark.sparkContext.broadcast(phrases)      # at most about BLOCK_BYTES of text

        def run(batches, shared=shared):
            p = shared.value
            numbers = _Numbers(p.ids)
            names = [str(i) for i in p.items]
            for b in batches:
                found = list(judge(binary_texts(b), p, numbers))
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(2), pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"s": s, "e": e} for s, e in f[1]] for f in found],
                             pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    pa.array([sorted(names[i] for i in f[2]) for f in found], pa.list_(pa.string())),
                ], names=["id", "key", "n_words", "spans", "items"])

        parts.append(rows.mapInArrow(
            run, f"id {kind}, key string, n_words long, spans array<struct<s:long,e:long>>, items array<string>"))
    if n == 1:
        return parts[0].drop("key")
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    merged = one.groupBy("id", "key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / n).cast("int").alias("copies"))
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) ->
        case when size(a) > 0 and x.s <= element_at(a, -1).e
             then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s,
                         greatest(element_at(a, -1).e, x.e) as e)))
             else concat(a, array(x)) end)""")
    return merged.select("id", "n_words", joined.alias("spans"), "items",
                         F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from ``contamination`` rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"), "spans")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> str:
    """``text`` without the bytes from the first to the last word of each span."""
    import re
    at = [m.span() for m in re.finditer(rb"\S+", text.translate(_FOLD))]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last:at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, text[last:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", policy: str = "drop",
                  window: int = WINDOW, **names) -> DataFrame:
    """``docs`` without benchmark passages; all columns and clean rows stay as they are.

    policy "drop" leaves out every document with a hit; "cut" removes the merged spans
    from its text (columns derived from the text are not recomputed). Rows pass through
    one Arrow stage per benchmark block; nothing is shuffled.
    """
    spark = docs.sparkSession
    item, item_text = names.get("item_col", "item_id"), names.get("item_text_col", "text")
    named = benchmark.where(F.col(item).isNotNull())
    mark = free_name(docs, "_text")
    for phrases in blocks(named, item, item_text, window, block_count(named, item_text)):
        shared = spark.sparkContext.broadcast(phrases)
        schema = docs.schema
        at = [c.lower() for c in docs.columns].index(text_col.lower())

        def run(batches, shared=shared, at=at):
            p = shared.value
            numbers = _Numbers(p.ids)
            for b in batches:
                texts = binary_texts(b, b.num_columns - 1)
                found = list(judge(texts, p, numbers))
                b = b.select(list(range(b.num_columns - 1)))
                if policy == "drop":
                    yield b.filter(pa.array([not f[1] for f in found], pa.bool_()))
                    continue
                old = b.column(at).to_pylist()
                new = [cut_spans(t, f[1]) if f[1] else o for t, f, o in zip(texts, found, old)]
                yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

        docs = docs.withColumn(mark, F.col(text_col).cast("string")).mapInArrow(run, schema)
    return docs


def sha_of(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
