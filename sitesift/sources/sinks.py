"""Sinks: contact CSV, nested JSON, one status row per page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.session import stored
from sitesift.sources.readers import CONTACT_CSV_FIELDS

__all__ = ["csv_projection", "write_contacts_csv", "nested_results", "nested_by_seed", "write_json", "page_status"]


def csv_projection(records: DataFrame, fields=None) -> DataFrame:
    """K1 shape: fixed columns in order, missing -> '', extra columns dropped."""
    fields = list(fields or CONTACT_CSV_FIELDS)
    return records.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in records.columns
                            else F.lit("").alias(f) for f in fields])


def write_contacts_csv(records: DataFrame, path: str, fields=None, mode: str = "overwrite") -> bool:
    """K1: header CSV; writes nothing for an empty input. Returns whether it wrote.

    Values are written as they are, outer spaces included. The input runs once: its rows
    are kept in the shared folder, looked at, then written."""
    rows = stored(csv_projection(records, fields), "csv_rows")
    if rows.isEmpty():
        return False
    (rows.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return True


def nested_results(mentions: DataFrame, seed_col: str | None = None) -> DataFrame:
    """K2 shape: one row per page: url -> sorted array of {type, value}; with a seed
    column, one row per (seed, page): a seed's pages may be many, so they are not
    gathered into one row here (see ``nested_by_seed``)."""
    keys = [*([seed_col] if seed_col else []), "url"]
    return mentions.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("type", "value"))).alias("extracted_info"))


def nested_by_seed(mentions: DataFrame, seed_col: str = "seed", max_pages: int = 50) -> DataFrame:
    """K2 shape of a crawl: one row per seed holding a map page url -> mentions. A crawl
    takes at most ``max_pages`` pages per seed, which bounds the row; a seed with more is
    an error, not cut."""
    per_page = nested_results(mentions, seed_col)
    size = F.size("pages")
    seeds = per_page.groupBy(seed_col).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("url", "extracted_info")))).alias("pages"))
    return seeds.withColumn("pages", F.when(size <= max_pages, F.col("pages")).otherwise(
        F.raise_error(F.concat(F.lit("more than the page cap for seed "), F.col(seed_col)))
        .cast(seeds.schema["pages"].dataType)))


def write_json(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).json(path)


def page_status(pages: DataFrame, mentions: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """K3: (page_id, url, status, errors, warnings, extracted_info) for every page.

    An empty page is a success with the warning 'Empty HTML content'. ``problems``
    (page_id, url, level, message) adds warnings and errors, e.g. of
    ``structure.jsonld_problems`` or a failed fetch; a page with an error is a failure
    without mentions. Joined on (page_id, url), as hashed ids may collide.
    """
    keys = ["page_id", "url"]
    pair = "array<struct<type:string,value:string>>"
    info = mentions.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("type", "value"))).alias("extracted_info"))
    empty = F.col("html").isNull() | (F.col("html") == "")
    out = pages.select(*keys, F.when(empty, F.array(F.lit("Empty HTML content")))
                       .otherwise(F.array().cast("array<string>")).alias("warnings")).join(info, keys, "left")
    if problems is None:
        out = out.withColumn("errors", F.array().cast("array<string>"))
    else:
        told = lambda level: F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("message"))))
        more = problems.groupBy(*keys).agg(told("error").alias("_errors"), told("warning").alias("_warnings"))
        none = F.array().cast("array<string>")
        out = (out.join(more, keys, "left").withColumn("errors", F.coalesce("_errors", none))
               .withColumn("warnings", F.concat("warnings", F.coalesce("_warnings", none))))
    failed = F.size("errors") > 0
    return out.select(*keys, F.when(failed, "failure").otherwise("success").alias("status"), "errors", "warnings",
                      F.when(failed, F.array().cast(pair))
                      .otherwise(F.coalesce("extracted_info", F.array().cast(pair))).alias("extracted_info"))
