"""Licence scans: TF-IDF cosine of sentences to licence templates, then inheritance from
the nearest ancestor directory.

DataFrame functions only. A page that is a whole licence text is compared to licence texts
as one set of words. Else its text is cut into sentences, and once more, with inline tags
dropped and wrapped lines joined, into windows as long as each header; the best cosine of
one of them to a template is the page's own licence. Licence files and index pages speak for
their directory; a page without a licence of its own takes that of the nearest directory
above it, found by joining its ancestors' paths to the claims.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import stored
from sitesift.llm.license_texts import TEXTS
from sitesift.llm.url_templates import url_parts

LEAST = 0.7            # cosine from which a sentence states a licence; no single term of a template has as much

#: Short statements, one or more for each licence (our own wording).
TEMPLATES = [
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-3-clause", "Distributed under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "All rights reserved."),
]

LEAST_TEXT = 0.8       # cosine from which a page is a whole licence text
#: Headers of files, looked for as windows of words along with the templates.
HEADERS = [(name, f"the terms of the GNU {kind}General Public License as published by the Free Software Foundation; "
            f"either version {v} of the License") for name, kind, v in (
                ("agpl-3.0", "Affero ", "3"), ("gpl-2.0", "", "2"), ("gpl-3.0", "", "3"), ("lgpl-2.0", "Library ", "2"),
                ("lgpl-2.1", "Lesser ", "2.1"), ("lgpl-3.0", "Lesser ", "3"))] + [
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-1.1", "Subject to the terms of the Mozilla Public License, version 1.1."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Words that name a licence; a window must have all those of its template, and of _APART no others.
_APART = "affero lesser library nc sa nd noncommercial sharealike noderivatives noderivs".split()
_NAMING = set(_APART) | set("apache bsd clause cc cc0 by creative commons attribution gnu general public mozilla mit license "
                            "domain rights reserved 1.0 1.1 2 2.0 2.1 3 4.0".split())

_TOKEN = r"[a-z0-9]+(?:[.][0-9]+)*"
_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice|legal|terms)([._-].*)?$"
_INDEX = r"(?i)^((index|readme)([._-].*)?)?$"
_BREAK = r"([.!?])[ \t\r\n]+"
_CUT = r"<[^>]*>|[\r\n]+"
_INLINE = r"(?i)</?(?:a|abbr|acronym|b|big|bdi|bdo|cite|code|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var)(?:\s[^>]*)?>"
_BLOCK = r"<[^>]*>|\r?\n[ \t]*\r?\n"


class Templates:
    """Distinct terms of each template and inverse document frequencies over the templates
    (a term of none counts as rarer than all). No single term reaches the threshold."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.rows = [(name, sorted(set(re.findall(_TOKEN, text.lower())))) for name, text in templates]
        self.lengths = [len(re.findall(_TOKEN, text.lower())) for _, text in templates]
        n = len(self.rows)
        df = {}
        for _, terms in self.rows:
            for t in terms:
                df[t] = df.get(t, 0) + 1
        self.idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in sorted(df.items())}
        self.rare = math.log(1 + n) + 1
        self.norms = [math.sqrt(sum(self.idf[t] ** 2 for t in terms)) for _, terms in self.rows]
        # A cosine of ``least`` needs shared mass of least^2 times the sentence's own. Foreign
        # terms weigh ``rare``^2 each and known ones no more than the heaviest, so a sentence
        # with a smaller part of known terms than this cannot reach it.
        known, foreign = max(self.idf.values()) ** 2, self.rare ** 2
        share = least * least
        self.part = share * foreign / (share * foreign + (1 - share) * known)


def sentences(html: Column) -> Column:
    """The distinct words of each sentence."""
    text = F.regexp_replace(html, _BREAK, "$1\n")
    return F.transform(F.split(text, _CUT), lambda s: F.array_distinct(_tokens(s)))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TOKEN})"), F.lit(1))


def _weigh(t: Templates):
    idf = F.map_from_arrays(F.array(*map(F.lit, t.idf)), F.array(*map(F.lit, t.idf.values())))
    return lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.pow(
        F.coalesce(F.element_at(idf, x), F.lit(t.rare)), F.lit(2.0)))


def _nearest(terms: Column, t: Templates, least: float) -> Column:
    """struct(score, order, name) of the best of an array of term sets, or null. Sets with
    too small a part of template terms for the threshold are not weighed (see
    ``Templates.part``); ties go to the smaller name."""
    vocabulary = F.array(*map(F.lit, t.idf))
    weigh = _weigh(t)

    def best(s):
        found = [F.struct(F.round(weigh(F.array_intersect(s["terms"], F.array(*map(F.lit, own))))
                                  / (s["norm"] * norm), 6).alias("score"),
                          F.lit(-k).alias("order"), F.lit(name).alias("name"))
                 for k, ((name, own), norm) in enumerate(zip(t.rows, t.norms))]
        return F.array_max(F.array(*found))

    # each step reads the one before, so terms and norm are made once a sentence
    likely = F.filter(terms, lambda w: (F.size(w) > 1) & (
        F.size(F.array_intersect(w, vocabulary)) >= F.size(w) * (t.part - 1e-9)))
    weighed = F.transform(likely, lambda w: F.struct(w.alias("terms"), F.sqrt(weigh(w)).alias("norm")))
    return F.array_max(F.filter(F.transform(weighed, best), lambda x: x["score"] >= least))


def header(html: Column, t: Templates, least: float = LEAST) -> tuple[Column, Column]:
    """(blocks, best): the page's blocks that can hold all naming words of a template, as
    arrays of words, to be named ``blocks``, and struct(score, order, name) of the best window of words in them, or null. Inline tags don't
    part words and single line ends are spaces. A window starts at a word of its template
    (no other start is better), is as long and has all its naming words."""
    weigh = _weigh(t)

    def windows(k, name, own, norm):
        needs = [x for x in own if x in _NAMING]
        mine, need = F.array(*map(F.lit, own)), F.array(*map(F.lit, needs))
        apart = F.array(*[F.lit(x) for x in _APART if x not in own])
        named = lambda w: F.size(F.array_intersect(w, need)) == len(needs)

        def cut(w):
            starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_contains(mine, F.element_at(w, i)))
            return F.transform(starts, lambda i: F.array_distinct(F.slice(w, i, t.lengths[k])))

        full = F.filter(F.flatten(F.transform(F.filter("blocks", named), cut)),
                        lambda w: named(w) & ~F.arrays_overlap(w, apart))
        return F.transform(full, lambda w: F.struct(
            F.round(weigh(F.array_intersect(w, mine)) / (F.sqrt(weigh(w)) * norm), 6).alias("score"),
            F.lit(-k).alias("order"), F.lit(name).alias("name")))

    # a window has all naming words of its template, so its block has the longest of them
    words = {max(_NAMING.intersection(own), key=lambda x: (len(x), x)) for _, own in t.rows if _NAMING.intersection(own)}
    likely = "|".join(map(re.escape, sorted(words))) or "(?!)"
    blocks = F.transform(F.filter(F.split(F.regexp_replace(html, _INLINE, ""), _BLOCK),
                                  lambda b: F.lower(b).rlike(likely)), _tokens)
    found = [windows(k, name, own, norm) for k, ((name, own), norm) in enumerate(zip(t.rows, t.norms))
             if _NAMING.intersection(own)]
    return blocks, F.array_max(F.filter(F.flatten(F.array(*found)), lambda x: x["score"] >= least))


def scan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
         templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of ``pages``: id, host, path, own_license, own_score, license (own
    or inherited), inherited_from (directory) and hops (directories up).

    Null texts state nothing; null urls and those without :// have an empty host and
    path, claim nothing and inherit nothing; of several claims for one directory the best
    score counts, then the smaller name; equal rows get equal results; an empty table
    gives no rows; other columns are ignored.
    """
    t = Templates(templates, least)
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    blocks, window = header(F.col("html"), Templates(list(templates) + HEADERS, least), least)
    rows = (rows.select("id", host.alias("host"), path.alias("path"), sentences(F.col("html")).alias("sentences"),
                        blocks.alias("blocks"))
            .withColumn("said", _nearest(F.col("sentences"), t, least)).withColumn("head", window)
            .withColumn("text", _nearest(F.array(F.array_distinct(F.flatten("sentences"))),
                                         Templates(TEXTS, LEAST_TEXT), LEAST_TEXT)))
    # the text of a licence names it best; a sentence without words around it comes before a
    # window unless that is nearer; reserved rights beside a named licence say nothing
    free = lambda c: F.when(F.col(f"{c}.name") != "proprietary", F.col(c))
    nearer = lambda a, b: F.when(a["score"].isNull() | (b["score"] > a["score"]), F.coalesce(b, a)).otherwise(a)
    rows = rows.withColumn("own", F.coalesce("text", nearer(free("said"), free("head")),
                                             nearer(F.col("said"), F.col("head"))))
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "(?s)^.*/", 0)).otherwise(F.lit("/"))
    rows = stored(rows.select("id", "host", "path", F.col("own.name").alias("own_license"),
                              F.col("own.score").alias("own_score"), folder.alias("folder"),
                              F.regexp_extract("path", "[^/]*$", 0).alias("base")), "license-rows")
    claims = (rows.where("own_license is not null and host <> ''")
              .where(F.col("base").rlike(_FILE) | F.col("base").rlike(_INDEX))
              .groupBy("host", F.col("folder").alias("above"))
              .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("name"))).alias("c"))
              .select("host", "above", F.col("c.name").alias("name")))
    # ancestors of each folder, itself first
    parts = F.split("folder", "/")
    above = F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1 - F.col("hops")), "/"), F.lit("/"))
    near = (rows.where("host <> ''").select("host", "folder").distinct()
            .select("host", "folder", F.explode(F.sequence(F.lit(0), F.size(parts) - 2)).alias("hops"))
            .withColumn("above", above)
            .join(claims, ["host", "above"])
            .groupBy("host", "folder").agg(F.min(F.struct("hops", "above", "name")).alias("n")))
    # written, so that the join reads both sides from exchanges of its own and a folder with most
    # of the pages can be split
    out = rows.join(stored(near, "license-near"), ["host", "folder"], "left")
    none = F.col("own_license").isNull()
    return out.select("id", "host", "path", "own_license", "own_score",
                      F.coalesce("own_license", "n.name").alias("license"),
                      F.when(none, F.col("n.above")).alias("inherited_from"),
                      F.when(none, F.col("n.hops")).cast("long").alias("hops"))


def oracle_sql(templates=TEMPLATES, least: float = LEAST) -> str:
    """The scan of ``pages`` in DuckDB SQL."""
    t = Templates(templates, least)
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    idf = ", ".join(f"('{w}', {v!r}::DOUBLE)" for w, v in t.idf.items())
    own = ", ".join(f"({k}, '{name}', '{w}', {norm!r}::DOUBLE)"
                    for k, ((name, terms), norm) in enumerate(zip(t.rows, t.norms)) for w in terms)
    return f"""
WITH idf(w, v) AS (VALUES {idf}), tmpl(k, name, w, norm) AS (VALUES {own}),
u AS (SELECT row_number() OVER () AS r, page_id, html,
      CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{az}', '{az.lower()}') AS host,
      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT r, page_id, host, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^.*/') ELSE '/' END AS folder,
      regexp_extract(path, '[^/]*$') AS base FROM p),
s AS (SELECT r, unnest(regexp_split_to_array(regexp_replace(html, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'),
      '<[^>]*>|[\\r\\n]+')) AS seg FROM p),
s2 AS (SELECT r, row_number() OVER () AS sid, seg FROM s),
w AS (SELECT DISTINCT r, sid, unnest(regexp_extract_all(lower(seg), '{_TOKEN}')) AS w FROM s2),
n AS (SELECT sid, sqrt(sum(pow(coalesce(v, {t.rare!r}::DOUBLE), 2))) AS norm FROM w LEFT JOIN idf USING (w) GROUP BY sid),
d AS (SELECT w.r, w.sid, tmpl.k, tmpl.name, sum(v * v) / max(n.norm * tmpl.norm) AS c
      FROM w JOIN tmpl USING (w) JOIN idf USING (w) JOIN n USING (sid) GROUP BY ALL),
o AS (SELECT r, max(struct_pack(score := round(c, 6), ord := -k, name := name)) AS b FROM d GROUP BY r),
x AS (SELECT q.*, CASE WHEN b.score >= {least} THEN b.name END AS own_license,
      CASE WHEN b.score >= {least} THEN b.score END AS own_score FROM q LEFT JOIN o USING (r)),
claims AS (SELECT host, folder AS above, min(struct_pack(s := -own_score, name := own_license)).name AS name FROM x
      WHERE own_license IS NOT NULL AND host <> '' AND (regexp_matches(base, '{_FILE}') OR regexp_matches(base, '{_INDEX}'))
      GROUP BY host, folder),
f AS (SELECT DISTINCT host, folder, string_split(folder, '/') AS parts FROM x WHERE host <> ''),
a AS (SELECT host, folder, h.hops, array_to_string(parts[1:len(parts) - 1 - h.hops], '/') || '/' AS above
      FROM f, LATERAL (SELECT unnest(range(0, len(parts) - 1)) AS hops) h),
near AS (SELECT a.host, a.folder, min(struct_pack(hops := a.hops, above := a.above, name := claims.name)) AS n
      FROM a JOIN claims USING (host, above) GROUP BY a.host, a.folder)
SELECT page_id, host, path, own_license, own_score, coalesce(own_license, n.name) AS license,
       CASE WHEN own_license IS NULL THEN n.above END AS inherited_from,
       CASE WHEN own_license IS NULL THEN n.hops END AS hops
FROM x LEFT JOIN near USING (host, folder)"""
