"""Exact row numbers within a key that stay balanced when one key holds a
large share of the rows.

``row_number() over (partition by key order by ...)`` puts a whole key on one
task. Here the rows are range-partitioned on (key, order), so a hot key spans
many partitions; each partition numbers its rows locally, and a small table of
per-(partition, key) counts (at most #keys + #partitions rows) supplies the
offset of rows of the same key in earlier partitions. The numbered table is
checkpointed to the shared checkpoint folder so ids stay fixed on retries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesift.session import ensure_checkpoint_dir


def row_number_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rn",
                      num_partitions: int | None = None,
                      per_key: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with its row number within ``keys`` from 1. ``per_key`` may turn the table of
    keys and their counts (keys, ``n``) into one with further columns, which every row
    then gets through the join on (partition, keys), so no join on the key alone is
    needed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = s.checkpoint(eager=True)
    s = s.withColumn("_li", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    per = (s.groupBy("_pid", *keys).agg(F.min("_li").alias("_first"), F.count(F.lit(1)).alias("_cnt")))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if per_key:
        sizes = per.groupBy(*keys).agg(F.sum("_cnt").alias("n"))
        per = per.join(per_key(sizes).drop("n"), keys)
    per = per.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (s.join(per, ["_pid", *keys])
            .withColumn(out, (F.col("_li") - F.col("_first") + F.col("_before") + 1).cast("long"))
            .drop("_pid", "_mid", "_li", "_first", "_cnt", "_before"))


def exclusive_prefix_sum(df: DataFrame, order_col: str, value_col: str, out: str = "start",
                         block: int = 4096) -> DataFrame:
    """Sum of ``value_col`` over all rows with a smaller ``order_col`` (a dense
    integer key), in three steps: totals of blocks of blocks, offsets of blocks inside
    each of those, offsets of rows inside each block. One task orders at most ``block``
    rows, or #rows / block^2 totals."""
    d = df.withColumn("_blk", F.floor(F.col(order_col) / block).cast("long"))
    before = lambda value, *part: F.coalesce(F.sum(value).over(
        Window.partitionBy(*part[:-1]).orderBy(part[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tot = (d.groupBy("_blk").agg(F.sum(value_col).alias("_bt"))
           .withColumn("_sup", F.floor(F.col("_blk") / block).cast("long")))
    sup = tot.groupBy("_sup").agg(F.sum("_bt").alias("_st")).withColumn("_soff", before("_st", "_sup"))
    tot = (tot.withColumn("_in_sup", before("_bt", "_sup", "_blk")).join(sup.select("_sup", "_soff"), "_sup")
           .select("_blk", (F.col("_soff") + F.col("_in_sup")).alias("_boff")))
    wi = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(value_col).over(wi), F.lit(0)))
    return (d.join(tot, "_blk").withColumn(out, (F.col("_boff") + F.col("_in")).cast("long"))
            .drop("_blk", "_boff", "_in"))
