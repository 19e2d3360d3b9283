"""Streaming jobs.

Sources are file streams (new parquet files arriving in a folder); sinks and
checkpoints live under the shared checkpoint folder, so a restarted or
re-scheduled query resumes from its last committed batch. ``available_now``
runs a query over everything present and stops, which is also how the tests
compare stream and batch results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.functions.urls import normalize_url
from sitesift.functions.text import long_enough
from sitesift.operators.extract import mention_array
from sitesift.session import scratch_path

BUCKETS = 1 << 13           # groups of URLs in a stream's state, the same as long as its checkpoint lives
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

__all__ = ["table_stream", "stream_contacts", "stream_visited", "stream_revisits", "stream_url_queue", "stream_rate"]


def table_stream(spark: SparkSession, folder: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files of one table in a folder: a directory ``<name>.parquet`` or
    ``<name>`` into which files arrive, or a single file ``<name>.parquet``. Large keyed
    state is kept in RocksDB, not in the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = folder.rstrip("/")
    path = f"{base}/{name}.parquet"
    if not _is_directory(spark, path) and _is_directory(spark, f"{base}/{name}"):
        path = f"{base}/{name}"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if _is_directory(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(base)


def _is_directory(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, so remote folders work."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _run(writer, available_now: bool):
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        q.awaitTermination()
    return q


def stream_contacts(spark: SparkSession, folder: str, out: str | None = None, titles=None,
                    table: str = "documents", available_now: bool = True, max_files_per_trigger: int | None = None):
    """Documents arriving as files -> e-mail, name, phone and title mentions ->
    distinct (doc, type, value) -> parquet, append.

    A document arrives as one row, so its mentions are made distinct inside the
    row (``array_distinct``) before exploding: no streaming state at all, where
    a ``dropDuplicates`` would keep every (doc, type, value) ever seen."""
    out = out or scratch_path(spark, "stream_contacts")
    docs = table_stream(spark, folder, table, max_files_per_trigger).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), "text")
    docs = docs.filter(long_enough(F.col("text")))
    arr = F.array_distinct(mention_array(F.col("text"), ("email", "name", "phone", "title"), titles))
    m = docs.select("page_id", "url", F.explode(arr).alias("_m")).select("page_id", "url", "_m.type", "_m.value")
    w = (m.writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/_checkpoint").outputMode("append"))
    _run(w, available_now)
    return spark.read.parquet(f"{out}/data")


def stream_visited(spark: SparkSession, folder: str, out: str | None = None, table: str = "pages",
                   available_now: bool = True, max_files_per_trigger: int | None = None):
    """The visited set as streaming state: each normalized URL is emitted once.

    The state is the visited set itself (one key per distinct URL), which is
    what the operator is; it has no event time to expire entries by."""
    out = out or scratch_path(spark, "stream_visited")
    u = table_stream(spark, folder, table, max_files_per_trigger).select(normalize_url(F.col("url")).alias("norm_url")) \
        .filter(F.col("norm_url").isNotNull()).dropDuplicates(["norm_url"])
    w = (u.writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/_checkpoint").outputMode("append"))
    _run(w, available_now)
    return spark.read.parquet(f"{out}/data")


def stream_revisits(spark: SparkSession, folder: str, out: str | None = None, table: str = "events", url: str = "url",
                    ttl_seconds: int = 3600, delay: str = "10 minutes", select=None, available_now: bool = True,
                    max_files_per_trigger: int | None = None):
    """T2 with bounded state: (url, ts) of every visit to a URL that was not visited within
    the ``ttl_seconds`` before. ``select`` turns the stream's rows into (url, ts).

    The state of a URL is the time of its last visit; event time drops it once the watermark
    is past that time and the ttl, so the state holds the URLs of the last ttl and delay, not
    all ever seen. URLs are kept and looked at by hash in BUCKETS groups: a call into Python
    costs some milliseconds, one for every URL is most of the time where there are many.
    Visits may come out of order within a batch; of those that come in a later batch, ones
    older than the watermark are left out."""
    out = out or scratch_path(spark, "stream_revisits")
    rows = table_stream(spark, folder, table, max_files_per_trigger)
    rows = (rows.select(F.col(url).alias("url"), "ts") if select is None else select(rows)).where("url IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)

    def visits(key, batches, state):
        import pandas as pd

        last = dict(zip(*state.get)) if state.exists else {}
        new = []
        if not state.hasTimedOut:
            for u, t in sorted(x for b in batches for x in zip(b["url"].tolist(), b["us"].tolist())):
                before = last.get(u)
                if before is None or t - before > ttl_seconds * 1_000_000:
                    new.append((u, t))
                last[u] = t if before is None else max(t, before)
        now = state.getCurrentWatermarkMs()
        ends = {u: t // 1000 + ttl_seconds * 1000 + 1 for u, t in last.items()}
        last = {u: t for u, t in last.items() if ends[u] >= now}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp(max(min(ends[u] for u in last), now + 1))
        else:
            state.remove()
        if new:
            yield pd.DataFrame(new, columns=["url", "us"])

    found = (rows.withColumn("us", F.unix_micros("ts")).withColumn("_bucket", F.pmod(F.xxhash64("url"), F.lit(BUCKETS))).groupBy("_bucket")
             .applyInPandasWithState(visits, "url string, us long", "urls array<string>, lasts array<long>", "append", "EventTimeTimeout"))
    w = (found.select("url", F.timestamp_micros("us").alias("ts")).writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/_checkpoint").outputMode("append"))
    q = _run(w, available_now)
    return spark.read.schema("url string, ts timestamp").parquet(f"{out}/data"), q


def stream_url_queue(spark: SparkSession, folder: str, out: str | None = None, table: str = "pages", keywords=None,
                     prepare=None, available_now: bool = True, max_files_per_trigger: int | None = None):
    """The continuous URL queue: while pages (page_id, url, html, and depth if they have it)
    arrive, every link on a page's own site that scores comes out once as (url, priority,
    depth), unless the page at its URL has arrived before or in the same batch. ``prepare``
    turns the stream's rows into pages.

    The known URLs are a table, one folder per batch: a batch's URLs are made distinct, those
    known from earlier batches are left out by a join, the others are written. A replayed
    batch overwrites its own folders, so a restarted query goes on from its last committed
    batch and what came out before does not come again."""
    from sitesift.functions.urls import url_netloc, with_joined_url
    from sitesift.operators.crawl import with_relevance
    from sitesift.operators.htmltree import parse_pages
    from sitesift.operators.structure import links

    out = out or scratch_path(spark, "stream_queue")
    pages = table_stream(spark, folder, table, max_files_per_trigger)
    pages = pages if prepare is None else prepare(pages)
    if "depth" not in pages.columns:
        pages = pages.withColumn("depth", F.lit(0))
    level = pages.select("page_id", "url", "html", F.col("depth").cast("long").alias("depth"))
    # a page's depth goes with its url through the parse
    parsed = parse_pages(level.select("page_id", F.concat_ws(" ", F.col("depth").cast("string"), "url").alias("url"), "html"))
    found = links(parsed).withColumn("depth", F.substring_index("url", " ", 1).cast("long") + 1)
    found = found.withColumn("url", F.expr("substring(url, instr(url, ' ') + 1)"))
    found = with_relevance(with_joined_url(found, "url", "href", "dst"), "dst", "text", "score", keywords)
    # rows are dropped through the aggregate's output, as in crawl_edges: a filter here would be
    # pushed down and repeat the resolution of URLs many times
    found = found.withColumn("_ok", (url_netloc(F.col("dst")) == url_netloc(F.col("url"))) & (F.col("score") > 0)).select(
        F.col("dst").alias("url"), F.when(F.col("_ok"), 100 - F.col("score")).cast("long").alias("priority"),
        F.when(F.col("_ok"), F.col("depth")).alias("depth"), F.lit(False).alias("page"))
    known = level.select("url", F.lit(None).cast("long").alias("priority"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("page"))
    rows = found.unionByName(known)

    queue = "url string, priority long, depth long"

    def write_batch(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        earlier = session.read.schema(f"{queue}, page boolean, b long").parquet(f"{out}/known").where(F.col("b") < batch_id)
        best = batch.groupBy("url").agg(F.min("priority").alias("priority"), F.min("depth").alias("depth"),
                                        F.max("page").alias("page")).where("page OR priority IS NOT NULL")
        at = f"{out}/known/b={batch_id}"
        best.join(earlier.select("url"), "url", "left_anti").write.mode("overwrite").parquet(at)
        new = session.read.schema(f"{queue}, page boolean").parquet(at).where("NOT page").drop("page")
        new.write.mode("overwrite").parquet(f"{out}/data/b={batch_id}")

    # empty folders, so that the first batch and a stream with no data read back
    spark.createDataFrame([], f"{queue}, page boolean").write.mode("overwrite").parquet(f"{out}/known/b=-1")
    spark.createDataFrame([], queue).write.mode("overwrite").parquet(f"{out}/data/b=-1")
    w = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{out}/_checkpoint")
    q = _run(w, available_now)
    return spark.read.schema(queue).parquet(f"{out}/data").select("url", "priority", "depth"), q


def stream_rate(spark: SparkSession, folder: str, out: str | None = None, period: str = "1 second",
                limit: int = 5, delay: str = "1 hour", table: str = "events", domain_col: str = "user_id",
                available_now: bool = True, max_files_per_trigger: int | None = None):
    """(domain, window) pairs over the request limit, on a stream.

    Event-time tumbling windows with a watermark (state of closed windows is
    dropped). Update mode emits a pair whenever its count changes; each batch is
    written to its own batch folder (overwritten on replay, so idempotent) and
    the current answer is the latest count per pair.
    """
    out = out or scratch_path(spark, "stream_rate")
    ev = table_stream(spark, folder, table, max_files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = (ev.withWatermark("ts", delay)
           .groupBy(F.window("ts", period).alias("w"), F.col(domain_col).alias("domain"))
           .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
           .select("domain", F.unix_seconds(F.col("w.start")).alias("window_start"),
                   F.unix_seconds(F.col("w.end")).alias("window_end"), "n"))

    def write_batch(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/b={batch_id}")

    # an empty batch folder with the result schema, so a stream with no data still reads back
    empty = spark.createDataFrame([], "domain long, window_start long, window_end long, n long, batch_id int")
    empty.write.mode("overwrite").parquet(f"{out}/data/b=-1")

    w = agg.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", f"{out}/_checkpoint")
    _run(w, available_now)
    res = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data/b=*")
    return (res.groupBy("domain", "window_start", "window_end")
            .agg(F.max_by("n", "batch_id").alias("n")))
