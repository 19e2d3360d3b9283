"""Streams equal batch; the driver contract."""

import os
import tempfile

from conftest import SF_SMALL
from pyspark.sql import functions as F


def test_stream_visited_equals_batch(spark):
    from sitesift.functions.urls import normalize_url
    from sitesift.streaming.jobs import stream_visited
    out = tempfile.mkdtemp(prefix="sitesift-test-")
    got = {r.norm_url for r in stream_visited(spark, SF_SMALL, out=os.path.join(out, "v")).collect()}
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    want = {r.n for r in pages.select(normalize_url(F.col("url")).alias("n")).distinct().collect()}
    assert got == want


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    # training-data queries, where present, are held against brute force in their own tests
    own = {k for k in set(q) - set(o) if k != "pipeline" and not k.startswith("op")}
    assert own == {"x_title_score"}


def test_every_oracle_sql_binds_in_duckdb_with_the_spark_columns(spark):
    import duckdb

    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    q = E.queries()
    cheap = ["x_email", "url_parse", "crawl_rate_audit", "html_vcard", "agg_type_counts", "v_title"]
    for k, sql in E.oracle_sql().items():
        cols = [r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall()]
        assert len(cols) == len(set(cols)), k
        if k in cheap:      # Spark side: schema only (no action) for a sample of keys
            assert sorted(q[k](spark, SF_SMALL).columns) == sorted(cols), k


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_properties(spark):
    import __spark_entry__ as E
    q = E.queries()
    # the document scan reads only the two columns it needs
    p = _plan(q["x_email"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p or "struct<doc_id:bigint,text:string>" in p
    # the page budget is a partial top-k before the shuffle
    assert "WindowGroupLimit" in _plan(q["crawl_budget"](spark, SF_SMALL))
    # selectors need no shuffle after the parse: no Exchange above the Python stage
    p = _plan(q["html_vcard"](spark, SF_SMALL))
    assert "MapInArrow" in p or "PythonMapInArrow" in p
    above = p.split("MapInArrow")[0]
    assert "Exchange" not in above


def _files(spark, folder, name, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def test_streams_over_a_directory_in_several_batches_with_restart(spark, tmp_path):
    from sitesift.streaming.jobs import ROCKSDB, stream_contacts, stream_rate, stream_visited
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages = "page_id long, url string, html string"
    _files(spark, src, "pages", [[(1, "http://a.x/1", "")], [(2, "http://A.x/1?q", ""), (3, "http://a.x/2", "")],
                                 [(4, "http://a.x/2", "")]], pages)
    one = lambda df: sorted(r.norm_url for r in df.collect())
    assert one(stream_visited(spark, src, out=f"{out}/v", max_files_per_trigger=1)) == ["http://a.x/1", "http://a.x/2"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ROCKSDB
    # restart: the state knows what earlier runs emitted
    _files(spark, src, "pages", [[(5, "http://a.x/1", ""), (6, "http://a.x/3", "")]], pages)
    assert one(stream_visited(spark, src, out=f"{out}/v", max_files_per_trigger=1)) == [
        "http://a.x/1", "http://a.x/2", "http://a.x/3"]
    _files(spark, src, "documents", [[(1, "mail a@b.co and a@b.co")], [(2, "mail a@b.co")]], "doc_id long, text string")
    got = stream_contacts(spark, src, out=f"{out}/c", max_files_per_trigger=1).collect()
    assert sorted((r.page_id, r.type, r.value) for r in got) == [(1, "email", "a@b.co"), (2, "email", "a@b.co")]
    # late data: an event older than the watermark (one hour behind the newest) is left out
    ev = "event_id long, ts string, user_id long"
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    _files(spark, src, "events", [[(1, at(1), 7), (2, at(1, 1), 7)], [(3, at(9), 7), (4, at(9, 2), 7)], [(5, at(9, 3), 7)],
                                  [(6, at(1, 2), 7), (7, at(9, 4), 7)]], ev)
    got = stream_rate(spark, src, out=f"{out}/r", period="1 hour", limit=1, delay="1 hour", max_files_per_trigger=1).collect()
    assert sorted(r.n for r in got) == [2, 4]
    again = stream_rate(spark, src, out=f"{out}/r", period="1 hour", limit=1, delay="1 hour", max_files_per_trigger=1).collect()
    assert sorted(r.n for r in again) == [2, 4]


def test_no_local_scratch_on_a_cluster(spark, monkeypatch):
    import pytest

    from sitesift import session

    class Context:
        master, getCheckpointDir = "yarn", staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)


def test_pages_outside_the_seeds_sites_are_not_parsed(spark):
    from sitesift.plans.site import site_pages
    pages = spark.createDataFrame([(1, "http://a.x/1", ""), (2, "http://b.x/1", "")], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://a.x",)], "seed string")
    assert [r.page_id for r in site_pages(seeds, pages).collect()] == [1]


def test_pipelines_shuffle_nothing_after_the_parse(spark):
    from sitesift.plans.contact import contact_info, wrapper_info
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    for df in (contact_info(pages), wrapper_info(pages)):
        p = _plan(df)
        assert "Exchange" not in p and "InMemoryTableScan" not in p and p.count("MapInArrow") == 1
