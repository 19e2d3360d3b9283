"""Sources and sinks: seed files, page files, contact CSV round trip."""

import os
import tempfile

import pytest

from sitesift.sources.readers import read_contacts_csv, read_pages, read_seeds
from sitesift.sources.sinks import csv_projection, nested_by_seed, nested_results, page_status, write_contacts_csv


def test_read_seeds(spark):
    d = tempfile.mkdtemp(prefix="sitesift-seeds-")
    with open(os.path.join(d, "seeds.txt"), "w") as f:
        f.write("  example.com \n\nhttps://a.example.org/x\n \t \n\thttpbin.example.net\t\n")
    got = [r.seed for r in read_seeds(spark, os.path.join(d, "seeds.txt")).collect()]
    assert got == ["http://example.com", "https://a.example.org/x", "httpbin.example.net"]


def test_read_pages_html_files_and_array_html(spark):
    d = tempfile.mkdtemp(prefix="sitesift-pages-")
    for i in range(3):
        with open(os.path.join(d, f"p{i}.html"), "w") as f:
            f.write(f"<html><body><p>page {i}</p>\n<p>x</p></body></html>")
    df = read_pages(spark, d, fmt="html")
    assert df.columns == ["page_id", "url", "html"] and df.count() == 3
    assert all("\n" in r.html for r in df.collect())          # whole file, not lines
    j = os.path.join(d, "j")
    spark.createDataFrame([("http://a/1", ["<p>a</p>", "<p>b</p>"])], "url string, html array<string>") \
        .write.json(j)
    r = read_pages(spark, j, fmt="json", schema="url string, html array<string>").first()
    assert r.html == "<p>a</p> <p>b</p>" and r.page_id is not None


def test_csv_round_trip_and_empty_input(spark):
    d = tempfile.mkdtemp(prefix="sitesift-csv-")
    recs = spark.createDataFrame([("  Ann, \"Lee\"\t", None, "a@b.co", None, "http://x/1", "extra")],
                                 "name string, title string, email string, linkedin string, src_url string, z string")
    assert write_contacts_csv(recs, os.path.join(d, "out"))
    back = read_contacts_csv(spark, os.path.join(d, "out")).collect()
    assert [tuple(r) for r in back] == [("  Ann, \"Lee\"\t", "", "a@b.co", "", "http://x/1")]
    assert not write_contacts_csv(recs.limit(0), os.path.join(d, "empty"))
    assert not os.path.exists(os.path.join(d, "empty"))
    assert csv_projection(recs).columns == ["name", "title", "email", "linkedin", "src_url"]


def test_nested_results_and_status(spark):
    m = spark.createDataFrame([(1, "http://s/1", "email", "a@b.co", "http://s/"), (1, "http://s/1", "name", "Ann Lee", "http://s/"),
                               (2, "http://s/2", "email", "c@d.co", "http://s/")],
                              "page_id long, url string, type string, value string, seed string")
    assert {(r.seed, r.url) for r in nested_results(m, seed_col="seed").collect()} == {
        ("http://s/", "http://s/1"), ("http://s/", "http://s/2")}
    assert set(nested_by_seed(m).first().pages) == {"http://s/1", "http://s/2"}
    with pytest.raises(Exception, match="page cap"):
        nested_by_seed(m, max_pages=1).collect()
    pages = spark.createDataFrame([(1, "http://s/1", "<p>x</p>"), (3, "http://s/3", "")], "page_id long, url string, html string")
    st = {r.page_id: r for r in page_status(pages, m).collect()}
    assert st[3].warnings == ["Empty HTML content"] and st[3].extracted_info == []
    assert len(st[1].extracted_info) == 2 and st[1].status == "success"
    told = spark.createDataFrame([(1, "http://s/1", "error", "HTTP 500"), (1, "http://s/1", "warning", "w"), (3, "http://s/3", "warning", "x")],
                                 "page_id long, url string, level string, message string")
    st = {r.page_id: r for r in page_status(pages, m, told).collect()}
    assert (st[1].status, st[1].errors, st[1].warnings, st[1].extracted_info) == ("failure", ["HTTP 500"], ["w"], [])
    assert (st[3].status, st[3].warnings) == ("success", ["Empty HTML content", "x"])


def test_command_line_end_to_end(tmp_path):
    import json
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.html").write_text('<div class="team"><p>Ann Lee</p> . <p>ann@x.example.com</p></div>'
                                  '<a href="mailto:bo@x.example.com">Mail Bo</a>')
    out = tmp_path / "out"
    r = subprocess.run([sys.executable, "-m", "sitesift", "--pages", str(pages), "--pages-format", "html",
                        "--out", str(out), "--format", "json", "--master", "local[2]", "--no-fuzzy"],
                       cwd=repo, capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    rows = [json.loads(ln) for p in out.glob("part-*.json") for ln in p.read_text().splitlines() if ln]
    values = {m["value"] for row in rows for m in row["extracted_info"]}
    assert {"Ann Lee", "ann@x.example.com", "bo@x.example.com"} <= values
