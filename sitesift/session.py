"""Session construction and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Conf keys tuned for the engine. On a cluster they come from the job's own
# spark-defaults; builder values here are only used when nothing is set.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the only Python stage (HTML parsing) ships pages in Arrow batches; pages are
    # up to tens of KB, so keep batches moderate to bound worker memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "sitesift", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system): executors
    do not see each other's disks, so a missing setting is an error there. Only with a
    local master is it filled in, by a temporary folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext handle (Spark Connect)
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        if sc is None or not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sitesift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def spread(df: DataFrame) -> DataFrame:
    """Deal ``df`` over ``sitesift.read.partitions`` tasks if that is set. For small files
    read as one split (tests, benchmarks); at scale the scan's own splits, sized by
    ``spark.sql.files.maxPartitionBytes``, are used and the setting is left out."""
    n = df.sparkSession.conf.get("sitesift.read.partitions", None)
    return df.repartition(int(n)) if n else df


def deal(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows of a few columns out before they become pages or are scored: a table small
    in bytes comes as one split however many rows it has, and each row costs much more than
    reading it. ``sitesift.read.partitions`` tasks if that is set, else three for each core
    and at least ``spark.sql.shuffle.partitions``, so the cluster's settings decide. Dealt in
    turn, or by the hash of columns ``by``."""
    spark = df.sparkSession
    n = spark.conf.get("sitesift.read.partitions", None)
    if n:
        return df.repartition(int(n), *by)
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext handle (Spark Connect)
        cores = 0
    return df.repartition(max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables,
    sink output and stream checkpoints (unique per call: a reused path would
    let a new stream resume an old checkpoint)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sitesift/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
