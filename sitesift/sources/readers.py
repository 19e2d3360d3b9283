"""Sources: seed lists, page tables, contact CSVs, fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesift.functions.text import strip_ws
from sitesift.session import spread

__all__ = ["seeds_from_lines", "read_seeds", "read_pages", "read_contacts_csv", "fetched_ok",
           "CONTACT_CSV_FIELDS", "read_table"]

CONTACT_CSV_FIELDS = ["name", "title", "email", "linkedin", "src_url"]


# text-heavy tables, CPU-bound per row: dealt out where sitesift.read.partitions asks for it
TEXT_TABLES = {"documents", "pages", "conversations"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def seeds_from_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Strip white space, drop blank lines, prefix 'http://' unless the line starts with 'http'."""
    s = strip_ws(F.col(col))
    return (lines.select(s.alias("seed")).filter(F.col("seed") != "")
            .select(F.when(F.col("seed").startswith("http"), F.col("seed"))
                    .otherwise(F.concat(F.lit("http://"), F.col("seed"))).alias("seed")))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return seeds_from_lines(spark.read.text(path))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", url_col: str = "url",
               html_col: str = "html", id_col: str = "page_id", schema: str | None = None) -> DataFrame:
    """A page table (page_id, url, html) from parquet / json / csv, or one HTML
    file per page (fmt='html': whole file as html, file path as url).
    An html column holding an array is joined with single spaces.

    JSON is read with ``schema`` (default: the three columns, html a string), so the
    input is not read a first time to infer one. Without an id column the id is a hash
    of the URL; ids may then collide, so joins of pages use (page_id, url)."""
    if fmt == "html":
        df = (spark.read.text(path, wholetext=True)
              .select(F.input_file_name().alias(url_col), F.col("value").alias(html_col)))
        df = df.withColumn(id_col, F.xxhash64(url_col))
    elif fmt == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif fmt == "json":
        df = spark.read.schema(schema or f"{id_col} long, {url_col} string, {html_col} string").json(path)
        if schema is None:
            df = df.withColumn(id_col, F.coalesce(id_col, F.xxhash64(url_col)))
    else:
        df = spark.read.format(fmt).load(path)
    if isinstance(df.schema[html_col].dataType, T.ArrayType):
        df = df.withColumn(html_col, F.array_join(F.col(html_col), " "))
    if id_col not in df.columns:
        df = df.withColumn(id_col, F.xxhash64(url_col))
    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.col(html_col).cast("string").alias("html"))


def read_contacts_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: header CSV, every value a string (no type inference); an empty field
    reads as '' (as a CSV dict reader gives it), not null; outer spaces are kept."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("inferSchema", False).csv(path))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def fetched_ok(log: DataFrame) -> DataFrame:
    """Fetch-log rows that succeeded (HTTP 200) with a non-empty body."""
    return log.filter((F.col("status") == 200) & (F.length("html") > 0))
