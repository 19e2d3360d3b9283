"""Command line: pages (and optional seeds) -> contacts.

    python -m sitesift --pages PATH [--pages-format parquet|json|csv|html]
                       [--seeds FILE] [--max-depth 3] [--max-pages 50]
                       [--profile contextual|wrapper] [--titles FILE]
                       --out PATH [--format csv|json|parquet] [--master local[*]]

With --seeds, the stored pages a crawl from each seed reaches are processed
(level-synchronous, depth and page cap per seed); without, every page is.
Output: validated contact records as CSV (name,title,email,linkedin,src_url),
nested JSON (one object per page with its distinct mentions; with --seeds one object per
seed holding its pages) or Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="sitesift", description=__doc__.split("\n\n")[0])
    ap.add_argument("--pages", required=True)
    ap.add_argument("--pages-format", default="parquet", choices=["parquet", "json", "csv", "html"])
    ap.add_argument("--seeds")
    ap.add_argument("--max-depth", type=int, default=3)
    ap.add_argument("--max-pages", type=int, default=50)
    ap.add_argument("--profile", default="contextual", choices=["contextual", "wrapper"])
    ap.add_argument("--titles", help="text file, one title keyword per line, in priority order")
    ap.add_argument("--no-fuzzy", action="store_true")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="csv", choices=["csv", "json", "parquet"])
    ap.add_argument("--master")
    a = ap.parse_args(argv)

    from sitesift.operators.aggregate import sparse_records
    from sitesift.operators.validate import validate_records
    from sitesift.plans.contact import contact_info, parsed_pages, wrapper_info
    from sitesift.plans.site import crawl_pages
    from sitesift.session import build_session, stored
    from sitesift.sources.readers import read_pages, read_seeds
    from sitesift.sources.sinks import nested_by_seed, nested_results, write_contacts_csv, write_json

    spark = build_session(a.master)
    titles = None
    if a.titles:
        with open(a.titles, encoding="utf-8") as f:
            titles = [ln.strip() for ln in f if ln.strip()]
    pages = read_pages(spark, a.pages, a.pages_format)
    taken = None
    if a.seeds:
        seeds = read_seeds(spark, a.seeds)
        taken = stored(crawl_pages(seeds, pages, a.max_depth, a.max_pages).select("seed", "page_id", "url").distinct(),
                       "taken")
        pages = pages.join(taken.select("page_id", "url").distinct(), ["page_id", "url"], "left_semi")
    parsed = parsed_pages(pages)
    if a.profile == "wrapper":
        mentions = wrapper_info(pages, titles=titles, parsed=parsed)
    else:
        mentions = contact_info(pages, titles=titles, fuzzy=not a.no_fuzzy, parsed=parsed)
    if a.format == "json":
        if taken is not None:
            of_seed = taken.join(mentions, ["page_id", "url"]).select("seed", "url", "type", "value")
            write_json(nested_by_seed(of_seed, max_pages=a.max_pages), a.out)
        else:
            write_json(nested_results(mentions.select("url", "type", "value")), a.out)
    else:
        records = validate_records(sparse_records(mentions), titles=titles)
        if a.format == "csv":
            write_contacts_csv(records, a.out)
        else:
            records.write.mode("overwrite").parquet(a.out)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
