"""Token counts through a digest cache.

A text's key is the digest of its normalised content and of the tokenizer file. Keys
are joined to the counts already stored; only distinct misses are encoded, and their
counts are appended to the cache table, which later runs read.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.llm.common import stored, strings

CACHE_SCHEMA = "key binary, n_tokens long"
MEMO = 1 << 17        # a worker forgets its units when it has more
_UNIT = re.compile("▁+[^▁]*")


def model_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Number of pieces a SentencePiece model gives for whole texts.

    Where no piece of the vocabulary holds a space mark after another character, merges
    never cross the start of a run of spaces, so the count of a text is the sum over its
    units (a run of spaces and the word behind it). Units recur, so their counts are
    remembered until there are over MEMO of them. With any other vocabulary texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        # the model keeps spaces as they are and marks the start of a text like a space
        plain = self.model.normalize("a  b\n c ") == "▁a▁▁b\n▁c▁"
        self.by_unit = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        self.memo: dict[str, int] = {}
        self.head = len(self.model.encode("a"))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            return [len(ids) if t else 0 for t, ids in zip(texts, self.model.encode(texts, num_threads=1))]
        units = [_UNIT.findall(("▁" + t).replace(" ", "▁")) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        memo = self.memo
        misses = list({u for of in units for u in of if u not in memo})
        for lo in range(0, len(misses), 4096):
            part = misses[lo:lo + 4096]
            # behind a word of its own a unit is encoded as inside a text
            coded = self.model.encode(["a" + u for u in part], num_threads=1)
            memo.update(zip(part, (len(ids) - self.head for ids in coded)))
        return [sum(map(memo.__getitem__, of)) for of in units]


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; the table is made where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8) and n_tokens, without begin, end
    or added special tokens.

    ``tokenizer`` is a file name in the public tokenizer folder, which every executor
    has. Null counts as the empty text (0 tokens); equal texts are encoded once; an
    empty table gives no rows; other columns are ignored. The cache may hold a key
    twice after runs that overlapped; both rows say the same.
    """
    spark = docs.sparkSession
    version = model_digest(tokenizer_path(tokenizer))
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))    # this model normalises nothing
    key = F.unhex(F.sha2(F.concat(F.lit(version), content), 256))
    # the keys are kept, not made again for the last join
    keyed = stored(docs.select(F.col(id_col).alias("id"), F.octet_length(content).cast("long").alias("n_bytes"),
                               key.alias("key")), "token-keys")
    known = open_cache(spark, cache_path).select("key").distinct()
    misses = (docs.select(key.alias("key"), content.alias("text"))
              .join(known, "key", "left_anti").dropDuplicates(["key"]))

    def encode(batches):
        c = counter(tokenizer_path(tokenizer))
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.counts(strings(part)), pa.int64())],
                                                 names=["key", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # one row a key, written, so that the join reads both sides from exchanges of its own and a
    # key with most of the documents can be split
    counts = stored(spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
                    .groupBy("key").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.join(counts, "key").select("id", "n_bytes", "n_tokens")
