"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.llm import (decontaminate, filter_audit, language_gru, licenses, line_crf, mixing, pii, prefix_trie, secret_scan,
                          simhash, token_counts, toxicity, url_templates)
from sitesift.llm.common import table
from sitesift.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and smallest reachable doc_id of every document (radius 2)."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query
def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and the line field's verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    crf = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge(docs, crf).withColumnRenamed("id", "doc_id")


@query
def op4_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a byte network fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return language_gru.predict(docs, language_gru.train(docs)).withColumnRenamed("id", "doc_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a lexicon and model learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of base kinds and all spans."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return pii.span_table(found).withColumnRenamed("id", "doc_id")


TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that starts empty."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER,
                                       scratch_path(spark, "token-cache"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                         (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).drop("spans").withColumnRenamed("id", "doc_id")


@query
def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or template verdict for every page url."""
    found = url_templates.judge(table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("id", "page_id")


#: Target weights of the mixture; sources not named share one lane.
TARGETS = {"src0": 0.12, **{f"src{k}": 0.044 for k in range(1, 20)}}
BLOCK = 64


@query
def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and position of every document in the mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, TARGETS, BLOCK)


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every page."""
    return licenses.scan(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


ORACLE["op5_license_scan"] = licenses.oracle_sql()


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals of five filters in all 120 orders, per source."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = filter_audit.oracle_sql()


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE["op13_prefix_trie"] = prefix_trie.oracle_sql()


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of base kinds and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.secrets(docs, secret_scan.train(docs))
    return secret_scan.span_table(found).withColumnRenamed("id", "doc_id")
