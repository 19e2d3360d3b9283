"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables and
columns with clashing names, for every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitesift.llm import (decontaminate, filter_audit, language_gru, licenses, line_crf, mixing, pii, secret_scan, simhash,
                          token_counts, toxicity, url_templates)
from sitesift.llm.common import stored, table
from sitesift.session import scratch_path

LONG = "the thing is that " * 12_000 + "\nmail a@b.org +1 (212) 555-0101 " + "9" * 5_000
ROWS = [(1, None, "en", "src0", None), (2, "", None, None, 0), (3, " \n\t ", "de", "src1", 4), (4, "...", "fr", "src0", 3),
        (5, LONG, "en", "src0", len(LONG)), (6, "the same text of one kind", "en", "src1", 25),
        (6, "the same text of one kind", "en", "src1", 25), (7, "the same text of one kind", None, "src0", None),
        (None, "the same text of one kind", "en", "src0", 1), (None, None, None, None, None),
        (8, "word " * 30, "es", "src9", 150), (9, "İK﻿ mail é@b.org \U0001f600 x", "es", "src9", 20)]
CLASH = ["id", "fp", "class", "component_id", "_id", "_n", "n_words", "kept", "score", "spans", "base", "more", "key",
         "lang_pred", "mix_slot", "mix_lane", "_rank", "_h", "_b", "_text", "u", "v", "items", "host", "word", "held_out"]


def docs_of(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(None if i % 2 else "x").cast("string").alias(c) for i, c in enumerate(CLASH)])


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (8, 0, 1), (3, 0, 0)],
                                 "doc_id long, quality int, toxic int")


def bench_of(spark):
    return spark.createDataFrame([(1, "word word"), (None, "the"), (2, None), (3, ""), (3, "!"), (1, "word word")],
                                 "item_id long, text string")


OPERATORS = {
    "crf": lambda s, d: line_crf.judge(d, line_crf.train(d, labels_of(s))),
    "gru": lambda s, d: language_gru.predict(d, language_gru.train(d, epochs=1)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels_of(s))),
    "pii": lambda s, d: pii.span_table(pii.personal_data(d)),
    "tokens": lambda s, d: token_counts.token_counts(d, "piece_bpe_32k.model", scratch_path(s, "edge-cache")),
    "secrets": lambda s, d: secret_scan.span_table(secret_scan.secrets(d, secret_scan.train(d))),
    "audit": lambda s, d: filter_audit.masks(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "benchmark": lambda s, d: decontaminate.digest(decontaminate.contamination(d, bench_of(s))),
    "mix": lambda s, d: mixing.mix(d, {"src0": 0.5, "src1": 0.2}, 2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_gives_one_row_per_row(spark, name):
    docs = docs_of(spark)
    found = OPERATORS[name](spark, docs)
    rows = found.collect()
    ids = sorted((r["doc_id"] if name == "mix" else r["id"] for r in rows), key=str)
    assert ids == sorted((r[0] for r in ROWS), key=str)
    if name != "mix":       # equal rows, equal results
        same = [tuple(r) for r in rows if r["id"] == 6]
        assert len(same) == 2 and same[0] == same[1]
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


def test_pages(spark):
    urls = [None, "", "x", "http://a.org/x/1", "http://a.org/x/1", "http://b.com/de/" + "y/" * 3000, "://", "http://é.org/ü?x"]
    pages = spark.createDataFrame([(None if k == 2 else k, u, None if k % 2 else "<p>All rights reserved.</p>" * k, "z")
                                   for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    for op in (url_templates.judge, licenses.scan):
        got = op(pages).collect()
        assert sorted((r["id"] for r in got), key=str) == sorted((None if k == 2 else k for k in range(len(urls))), key=str)
        assert op(pages.limit(0)).collect() == []


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    bench_of(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(spark)
    for start in (docs, docs.limit(0)):
        cur = start
        for name, stage in corpus_pipeline.STAGES:
            before = cur
            cur = stored(stage(spark, cur, str(tmp_path)), f"edge-{name}")
            assert cur.count() <= before.count()
            if name != "mix":
                assert cur.columns == docs.columns and [f.dataType for f in cur.schema] == [f.dataType for f in docs.schema]
        assert set(docs.columns) <= set(cur.columns)


def test_pipeline_against_plain_steps(spark):
    """run() on the smallest tables: each stage's rows follow from its operator's results."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    net = language_gru.train(docs)
    known = {r["id"] for r in language_gru.predict(docs, net).collect()
             if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE}
    from test_simhash import plain_components, plain_fingerprint
    fps = {i: plain_fingerprint(text[i]) for i in known}
    once = {i for i, low in plain_components(fps).items() if i == low}
    from test_decontaminate import plain
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    clean = {i for i in once if not plain(text[i], items)[-1]}
    assert set(got) == clean and 0 < len(clean) < len(text)
    for i, r in got.items():
        spans = pii.base_spans(text[i])
        assert not pii.base_spans(r["text"]) and (spans or "[" in r["text"] or r["text"] == text[i])
        assert r["n_chars"] == len(r["text"])
    assert sorted(r["mix_position"] // corpus_pipeline.BLOCK for r in got.values()) == sorted(r["mix_slot"] for r in got.values())
