"""Fuzzy title scoring as array expressions (no join with the dictionary).

The "tiered" score of keyword k against a query q (both lower-cased, every
character outside [a-z0-9] turned into a space, trimmed):
    60 if k is a substring of q, else 57 if they share a word, else
    round(100 * (1 - levenshtein(k, q) / max(len))) capped at 56.
Levenshtein is only evaluated where the lengths allow a ratio over the cut-off; this
keeps page-length text cheap and never changes which keywords pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["process_fuzzy", "fuzzy_titles_of", "fuzzy_titles_sql", "windows_sql", "covered_sql", "with_fuzzy_query", "tiered_sql", "levenshtein_ratio",
           "fuzzy_match"]


def process_fuzzy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "))


def windows_sql(words: str, shift: int = 3) -> str:
    """The three-word windows of an array given by name, joined by spaces."""
    k = f"greatest(size({words}) - {shift}, 0)"
    return (f"array_join(zip_with(zip_with(slice({words}, 1, {k}), slice({words}, 2, {k}), "
            f"(a, b) -> concat(a, ' ', b)), slice({words}, 3, {k}), (ab, c) -> concat(ab, ' ', c)), ' ')")


def covered_sql(words: str, shift: int = 3) -> str:
    """The words that the windows of ``windows_sql`` hold, each place once, joined by spaces."""
    return f"array_join(if(size({words}) > {shift}, slice({words}, 1, size({words}) - {shift} + 2), slice({words}, 1, 0)), ' ')"


FQ, FQL, FQP, FQU = "_fuzzy_q", "_fuzzy_ql", "_fuzzy_qpad", "_fuzzy_qwords"


def with_fuzzy_query(df, text: Column, all_windows: bool = False):
    """Windows of three words over the words of the cleaned text: by default they start at
    0 .. n-4, so texts of fewer than 4 words give none and the last window is never formed
    (as in the behaviour reproduced); ``all_windows`` starts them at 0 .. n-3.

    Stage the processed window string, its length and a space-padded copy as
    columns, so the per-keyword scoring reads attributes instead of
    recomputing them (each keyword test is then one substring search).
    Higher-order functions are written as SQL text over the staged columns
    (cheap to build; a Python lambda costs tens of milliseconds to create)."""
    from sitesift.functions.text import clean_text

    shift = 2 if all_windows else 3
    df = df.withColumn("_fuzzy_clean", clean_text(text))
    df = df.withColumn("_fuzzy_words", F.expr("filter(split(_fuzzy_clean, ' '), w -> w != '')"))
    df = df.withColumn(FQ, process_fuzzy(F.expr(windows_sql("_fuzzy_words", shift))))
    df = df.withColumn(FQU, F.concat(F.lit(" "), process_fuzzy(F.expr(covered_sql("_fuzzy_words", shift))), F.lit(" ")))
    df = df.withColumn(FQL, F.length(F.col(FQ))).withColumn(FQP, F.concat(F.lit(" "), F.col(FQ), F.lit(" ")))
    return df.drop("_fuzzy_clean", "_fuzzy_words")


def tiered_sql(min_score: int, q: str = FQ, ql: str = FQL, qp: str = FQP) -> str:
    """The tiered score of dictionary entry ``d`` for a query, its length and its padded
    copy, given as SQL names. A ratio is at most
    100 * min(len) / max(len); where even that, rounded, cannot exceed ``min_score``, the
    entry loses whatever its distance, and Levenshtein is not evaluated."""
    return f"""CASE WHEN d.kpl = 0 OR coalesce({ql}, 0) = 0 THEN 0
     WHEN contains({q}, d.kp) THEN 60
     WHEN d.many AND exists(d.kws, w -> contains({qp}, w)) THEN 57
     WHEN 200 * least(d.kpl, {ql}) < {2 * int(min_score) + 1} * greatest(d.kpl, {ql}) THEN -1
     ELSE least(56, CAST(round(100.0 * (1.0 - levenshtein(d.kp, {q}) / greatest(d.kpl, {ql}))) AS INT)) END"""


def fuzzy_titles_of(keywords: list[str], k: int = 5, min_score: int = 30) -> Column:
    """Top-k dictionary keywords by tiered score (> min_score), ties in dictionary
    order, over the staged query columns (see ``with_fuzzy_query``)."""
    return F.expr(fuzzy_titles_sql(keywords, k, min_score)) if keywords else F.array().cast("array<string>")


def fuzzy_titles_sql(keywords: list[str], k: int = 5, min_score: int = 30, q: str = FQ, ql: str = FQL,
                     u: str = FQU) -> str:
    """``fuzzy_titles_of`` as SQL text over a query given by name, its length and its words,
    each place once, between spaces. Substrings come first, then shared words, then the edit
    distance, each looked for only where the ones before gave fewer than ``k``. Each word of a
    keyword lies inside one word, so its longest and shared words are sought in ``u``, a third
    of ``q``."""
    from sitesift.functions.text import struct_array_sql

    k, low = max(int(k), 0), int(min_score)
    entries = []
    for i, kw in enumerate(keywords):
        kp = _process_py(kw)
        # a one-word keyword that is not a substring cannot be a shared word either
        words = [f" {w} " for w in kp.split()]
        entries.append({"kw": kw, "ord": i, "kp": kp, "kpl": len(kp), "many": len(words) > 1, "kws": words or [" "],
                        "long": max(kp.split(), key=len, default="")})
    none = "cast(array() AS array<string>)"
    if low < 0 and entries:     # every keyword passes, with its score
        scored = (f"transform({struct_array_sql(entries)}, d -> named_struct('neg', "
                  f"-({tiered_sql(low, q, ql, u)}), 'ord', d.ord, 'kw', d.kw))")
        return f"transform(slice(array_sort(filter({scored}, x -> -x.neg > {low})), 1, {k}), x -> x.kw)"
    entries = [d for d in entries if d["kp"]]       # an empty keyword scores 0
    if not entries or not k or low >= 60:
        return none
    many = [d for d in entries if d["many"]]
    held = f"contains({u}, d.long) AND (NOT d.many OR contains({q}, d.kp))"
    shared = f"d.many AND exists(d.kws, w -> contains({u}, w))"
    first = f"transform(filter({struct_array_sql(entries)}, d -> {held}), d -> d.kw)"
    second = (f"transform(filter({struct_array_sql(many)}, d -> NOT contains({q}, d.kp) AND {shared}), d -> d.kw)"
              if many and low < 57 else none)
    third = (f"transform(array_sort(filter(transform(filter({struct_array_sql(entries)}, d -> "
             f"200 * least(d.kpl, {ql}) >= {2 * low + 1} * greatest(d.kpl, {ql}) AND NOT array_contains(g, d.kw)), "
             f"d -> named_struct('neg', -least(56, CAST(round(100.0 * (1.0 - levenshtein(d.kp, {q}) / "
             f"greatest(d.kpl, {ql}))) AS INT)), 'ord', d.ord, 'kw', d.kw)), x -> -x.neg > {low})), x -> x.kw)"
             if low < 56 else none)
    # one-item arrays stand for names: what is found in a step is an array that the next one reads
    more = f"transform(array(concat(h, {second})), g -> if(size(g) >= {k}, g, concat(g, {third})))[0]"
    found = f"transform(array({first}), h -> if(size(h) >= {k}, h, {more}))[0]"
    return f"if(coalesce({ql}, 0) = 0, {none}, slice({found}, 1, {k}))"


def _process_py(s: str) -> str:
    import re
    return re.sub("[^a-z0-9]", " ", s.lower()).strip()


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """round(100 * (1 - levenshtein / max length)) on lower-cased strings; 0 if both empty."""
    la, lb = F.lower(a), F.lower(b)
    mx = F.greatest(F.length(la), F.length(lb))
    return F.when(mx == 0, F.lit(0)).otherwise(
        F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(la, lb) / mx)).cast("int"))


def fuzzy_match(a: Column, b: Column, threshold: int = 50) -> Column:
    return levenshtein_ratio(a, b) >= threshold
