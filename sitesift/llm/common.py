"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.session import stored

__all__ = ["table", "stored", "fold", "free_name", "binary_texts", "strings"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str) -> Column:
    """crc32 of the id's text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def free_name(df: DataFrame, base: str) -> str:
    """A column name no column of ``df`` has (columns compare case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def binary_texts(batch, index: int = 1) -> list[bytes]:
    """UTF-8 bytes of a text column of an Arrow batch; null counts as empty."""
    return [b or b"" for b in batch.column(index).cast("binary").to_pylist()]


def strings(batch, index: int = 1) -> list[str]:
    return [s or "" for s in batch.column(index).to_pylist()]
