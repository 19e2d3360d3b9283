"""Corpus pipeline: language ID, near-duplicates, benchmark passages, personal data,
source mixing. Each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitesift.llm import decontaminate, language_gru, mixing, pii, simhash
from sitesift.llm.common import stored, table
from sitesift.llm.queries import BLOCK, TARGETS

LEAST_LANGUAGE = 0.4     # mean probability below which no language is recognised


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (4): texts without letters or without a recognised language go."""
    return language_gru.keep_known(docs, language_gru.train(docs), least=LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (9): one document of each group stays."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (10): documents with a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), policy="drop")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (7): personal data is replaced by marks in the text."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (3): every document gets its slot and position in the mixture."""
    return mixing.mix(docs, TARGETS, BLOCK)


STAGES = [("language", language_id), ("simhash", near_duplicates), ("benchmark", benchmark_passages),
          ("pii", personal_data), ("mix", source_mix)]

ORACLE_SQL = None    # the trained stages have no SQL form; tests hold run() against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``documents`` that pass every stage, with their place in the mixture."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
