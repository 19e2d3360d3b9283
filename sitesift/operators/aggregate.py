"""Distinct, union, dedup, record shaping, confidence, counts, relevance order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.dictionaries import BASE_CONFIDENCE, OTHER_RANK, TYPE_RANK, WEIGHT_FACTOR
from sitesift.functions.urls import url_netloc

RECORD_TYPES = ["email", "name", "linkedin", "title", "phone", "organization"]
NOT_FOUND = "not_found"


def distinct_mentions(m: DataFrame, keys=("page_id", "url")) -> DataFrame:
    """A1: per page, drop malformed and 'not_found' rows, keep distinct (type, value).

    A hash aggregate with map-side partial dedup; the shuffle key includes the
    value, so a page (or a value) that dominates does not land on one task.
    """
    return (m.filter(F.col("type").isNotNull() & F.col("value").isNotNull() & (F.col("value") != NOT_FOUND))
            .select(*keys, "type", "value").dropDuplicates([*keys, "type", "value"]))


def union_all(*dfs: DataFrame) -> DataFrame:
    """A2: bag union by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def norm_value(type_col: Column, value: Column) -> Column:
    return F.when(type_col == "email", F.lower(F.trim(value))).otherwise(F.trim(value))


def global_dedup(m: DataFrame) -> DataFrame:
    """A3: contacts across pages: one row per (type, normalized value) with the
    smallest source url and the number of distinct pages."""
    return (m.withColumn("norm_value", norm_value(F.col("type"), F.col("value")))
            .groupBy("type", "norm_value")
            .agg(F.min("url").alias("first_url"), F.count_distinct("url").alias("n_pages")))


def sparse_records(m: DataFrame) -> DataFrame:
    """A4: one record per mention with one column per type (others null) + src_url."""
    cols = [F.when(F.col("type") == t, F.col("value")).alias(t) for t in RECORD_TYPES]
    return m.select(*cols, F.col("url").alias("src_url"))


def wide_records(m: DataFrame, keys=("url",)) -> DataFrame:
    """A4 wide form: one row per page with a sorted array of values per type."""
    return (m.groupBy(*keys).pivot("type", RECORD_TYPES)
            .agg(F.sort_array(F.collect_set("value"))))


def mention_confidence(m: DataFrame) -> DataFrame:
    """A5: min(base x weight factor, 1.0), best over the hits of (url, type, value)."""
    factor = F.coalesce(F.create_map(*[x for kv in WEIGHT_FACTOR.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
                        [F.col("weight")], F.lit(1.0))
    conf = F.least(F.coalesce(F.col("confidence"), F.lit(BASE_CONFIDENCE)) * factor, F.lit(1.0))
    return m.groupBy("url", "type", "value").agg(F.max(conf).alias("confidence"))


def type_counts(m: DataFrame) -> DataFrame:
    """Mention counts per site and page with site and grand totals (rollup)."""
    per_type = [F.count_if(F.col("type") == t).cast("long").alias(f"n_{t}") for t in RECORD_TYPES]
    return (m.withColumn("netloc", url_netloc("url"))
            .rollup("netloc", "url").agg(F.count(F.lit(1)).alias("n_mentions"), *per_type))


def relevance_rank(type_col: Column) -> Column:
    r = None
    for t, v in TYPE_RANK.items():
        r = F.when(type_col == t, F.lit(v)) if r is None else r.when(type_col == t, F.lit(v))
    return r.otherwise(F.lit(OTHER_RANK))


def sort_by_relevance(m: DataFrame, keys=("url",)) -> DataFrame:
    """Distinct (type, value) per page ranked email > name > phone > title > other,
    ties by value; ``rn`` is the position within the page."""
    d = m.select(*keys, "type", "value").dropDuplicates([*keys, "type", "value"])
    d = d.withColumn("relevance", relevance_rank(F.col("type")))
    w = Window.partitionBy(*keys).orderBy(F.col("relevance").desc(), F.col("value"), F.col("type"))
    return d.withColumn("rn", F.row_number().over(w))
