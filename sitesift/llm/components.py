"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.session import ensure_checkpoint_dir


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Rows (node, root): root is the smallest node reachable. Input: long columns.

    Large star then small star, each a min per node (combined map-side) joined back,
    until the edge set stops changing; every round is written to the shared
    checkpoint folder. Nodes without an edge to another node do not appear. Null
    ends are ignored; an empty edge table gives an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = (edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
         .where(F.col(u).isNotNull() & F.col(v).isNotNull()).where("u <> v").distinct().checkpoint())
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(m2, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
            .where("u <> v").distinct())
        e = small.checkpoint()
        new = _state(e)
        if new == state:
            break
        state = new
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
