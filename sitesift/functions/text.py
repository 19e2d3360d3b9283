"""Text and extraction column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesift.functions import patterns as P

__all__ = [
    "clean_text", "find_all", "emails_in", "names_in", "phones_in", "titles_in",
    "wrapper_emails_in", "wrapper_names_in", "wrapper_phones_in", "wrapper_title_of",
    "strip_ws", "long_enough", "lit_array", "struct_array_sql", "sql_quote", "holds_any_sql",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip()``)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def clean_text(c) -> Column:
    """Collapse whitespace runs to one space and trim; keep the input if that is empty."""
    c = _c(c)
    cleaned = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(cleaned == "", c).otherwise(cleaned)


def find_all(c, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches, left to right; empty or null text gives []."""
    c = _c(c)
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def long_enough(c) -> Column:
    """Texts shorter than 3 characters are not searched."""
    return F.length(_c(c)) >= P.MIN_TEXT_LEN


def emails_in(c, cleaned: Column | None = None) -> Column:
    return find_all(clean_text(c) if cleaned is None else cleaned, P.EMAIL)


def names_in(c) -> Column:
    # names are matched on the raw text (no whitespace cleaning); honorific dropped
    return F.transform(find_all(c, P.NAME, 1), lambda s: strip_ws(s))


def phones_in(c, cleaned: Column | None = None) -> Column:
    return F.transform(find_all(clean_text(c) if cleaned is None else cleaned, P.PHONE), lambda s: strip_ws(s))


def titles_in(c, keywords: list[str], cleaned: Column | None = None) -> Column:
    if not keywords:
        return F.array().cast("array<string>")
    return find_all(clean_text(c) if cleaned is None else cleaned, P.title_alternation(keywords), 1)


def wrapper_emails_in(c) -> Column:
    return find_all(c, P.EMAIL)


def wrapper_names_in(c) -> Column:
    return find_all(c, P.WRAPPER_NAME)


def wrapper_phones_in(c) -> Column:
    return find_all(c, P.WRAPPER_PHONE)


def sql_quote(v) -> str:
    """A SQL literal for a Python str/int/float (strings single-quoted, escaped)."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


def lit_array(values: list[str]) -> Column:
    """A constant string array, built as one SQL expression (one call to the JVM,
    instead of one per element)."""
    if not values:
        return F.array().cast("array<string>")
    return F.expr("array(" + ", ".join(sql_quote(v) for v in values) + ")")


def struct_array_sql(rows: list[dict]) -> str:
    def one(r):
        fields = []
        for k, v in r.items():
            val = ("array(" + ", ".join(sql_quote(x) for x in v) + ")") if isinstance(v, list) else sql_quote(v)
            fields.append(f"'{k}', {val}")
        return "named_struct(" + ", ".join(fields) + ")"
    return "array(" + ", ".join(one(r) for r in rows) + ")"


def _shortest(keywords: list[str]) -> list[str]:
    """The keywords that contain no other one: a text that holds any keyword holds one of them."""
    return [k for k in dict.fromkeys(keywords) if not any(o != k and o in k for o in keywords)]


def holds_any_sql(text: str, keywords: list[str]) -> str:
    """Whether a text given as SQL, lower-cased, contains any of the keywords."""
    words = "array(" + ", ".join(sql_quote(k) for k in _shortest(keywords)) + ")"
    return f"exists(array(lower({text})), _low -> exists({words}, _k -> contains(_low, _k)))"


def wrapper_title_of(c, keywords: list[str]) -> Column:
    """The whole text if it contains any keyword (case-insensitive substring), else null."""
    c = _c(c)
    if not keywords:
        return F.lit(None).cast("string")
    kws = lit_array(_shortest([k.lower() for k in keywords]))
    return F.when(F.exists(F.array(F.lower(c)), lambda low: F.exists(kws, lambda k: F.contains(low, k))), c)
