"""Table functions for SQL: ``SELECT ... FROM pages, LATERAL html_elements(html)``.

``register_table_functions(spark)`` makes them known to a session. They parse in Python
workers, row by row of the lateral join; plans in Python should use ``parse_pages``, which
parses whole batches and keeps a page in one row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

__all__ = ["register_table_functions", "HtmlElements", "HtmlTexts", "HtmlLinks"]


class HtmlElements:
    """One row per element, in document order; none for a page that cannot be parsed."""

    def eval(self, html: str):
        from sitesift.operators.htmltree import parse_or_error

        text, elements, _, _ = parse_or_error(html)
        for e in elements:
            yield (e["node_id"], e["parent_id"], e["sib_idx"], e["next_sib"], e["last_desc"], e["tag"], dict(e["attrs"]),
                   text[e["text_start"]:e["text_end"]])


class HtmlTexts:
    """One row per text node that is not white space, stripped, in document order."""

    def eval(self, html: str):
        from sitesift.operators.htmltree import parse_or_error

        text, _, nodes, _ = parse_or_error(html)
        for n in nodes:
            if n["s_end"] > n["s_start"]:
                yield n["pos"], n["node_id"], text[n["s_start"]:n["s_end"]]


class HtmlLinks:
    """One row per <a> with an href, in document order."""

    def eval(self, html: str):
        from sitesift.operators.htmltree import parse_or_error

        text, elements, _, _ = parse_or_error(html)
        for e in elements:
            attrs = dict(e["attrs"])
            if e["tag"] == "a" and "href" in attrs:
                yield e["node_id"], text[e["text_start"]:e["text_end"]], attrs["href"]


TABLE_FUNCTIONS = {
    "html_elements": (HtmlElements, "node_id int, parent_id int, sib_idx int, next_sib int, last_desc int, tag string, "
                                    "attrs map<string,string>, text string"),
    "html_texts": (HtmlTexts, "pos int, node_id int, text string"),
    "html_links": (HtmlLinks, "node_id int, text string, href string"),
}


def register_table_functions(spark: SparkSession) -> list[str]:
    """Register html_elements, html_texts and html_links; returns their names."""
    for name, (cls, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=schema, useArrow=True))
    return list(TABLE_FUNCTIONS)
