"""Mention extraction: text columns -> (type, value) rows.

All matching is native regex (``regexp_extract_all``); titles use one
alternation built from the dictionary in order, fuzzy titles an array
expression (see functions/fuzzy.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesift.dictionaries import WRAPPER_TITLES, keyword_list, large_dictionary
from sitesift.functions.fuzzy import fuzzy_titles_of, with_fuzzy_query
from sitesift.functions.text import (clean_text, emails_in, long_enough, names_in, phones_in,
                                     titles_in, wrapper_emails_in, wrapper_names_in,
                                     wrapper_phones_in, wrapper_title_of)

MENTION_COLS = ["page_id", "url", "origin", "type", "value", "weight", "confidence"]
DIRECT_TYPES = ("email", "name", "title")
CONTEXT_TYPES = ("email", "name", "phone", "title")


def _typed(arr: Column, typ: str) -> Column:
    return F.transform(arr, lambda v: F.struct(F.lit(typ).alias("type"), v.alias("value")))


def mention_array(text: Column, types=CONTEXT_TYPES, titles=None, fuzzy: bool = False,
                  fuzzy_k: int = 5, fuzzy_min: int = 30, all_windows: bool = False,
                  cleaned: Column | None = None) -> Column:
    """array<struct<type,value>> of the mentions of ``types`` found in ``text``
    (``cleaned``: the whitespace-cleaned text, when already staged as a column)."""
    kws = keyword_list(titles)
    parts = []
    for t in types:
        if t == "email":
            parts.append(_typed(emails_in(text, cleaned), "email"))
        elif t == "name":
            parts.append(_typed(names_in(text), "name"))
        elif t == "phone":
            parts.append(_typed(phones_in(text, cleaned), "phone"))
        elif t == "title":
            parts.append(_typed(titles_in(text, kws, cleaned), "title"))
            if fuzzy:
                # needs the staged query columns (text_mentions adds them)
                parts.append(_typed(fuzzy_titles_of(kws, fuzzy_k, fuzzy_min), "title"))
        else:
            raise ValueError(f"unknown mention type {t}")
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _raw_arrays(text: Column, cleaned: Column, types, kws) -> dict:
    """Per type, the array of raw matches (phones still unstripped)."""
    from sitesift.functions import patterns as P
    from sitesift.functions.text import find_all
    out = {}
    for t in types:
        if t == "email":
            out[t] = find_all(cleaned, P.EMAIL)
        elif t == "name":
            out[t] = find_all(text, P.NAME, 1)      # group 1 starts and ends with a letter: nothing to strip
        elif t == "phone":
            out[t] = find_all(cleaned, P.PHONE)
        elif t == "title":
            out[t] = titles_in(text, kws, cleaned)
        else:
            raise ValueError(f"unknown mention type {t}")
    return out


def text_mentions(df: DataFrame, text_col: str = "text", ids=("page_id", "url"), origin: str = "text",
                  types=DIRECT_TYPES, titles=None, fuzzy: bool = False, min_len: int | None = 3,
                  weight: Column | None = None, confidence: Column | None = None, **kw) -> DataFrame:
    """Explode the mentions of one text column into mention rows.

    ``min_len`` skips texts shorter than 3 characters (the "safe" entry point);
    context blocks pass ``None`` because they are searched whatever their length.
    The cleaned text and each type's matches are staged as columns; the typed
    union is one SQL expression over them. A title dictionary too long for that is joined
    as a table (operators/vocabulary.py).
    """
    if "title" in types and (table := large_dictionary(df.sparkSession, titles)) is not None:
        return _mentions_by_table(df, table, text_col, ids, origin, types, fuzzy, min_len, weight, confidence, **kw)
    kws = keyword_list(titles) if "title" in types else []
    src = df if min_len is None else df.filter(long_enough(F.col(text_col)))
    if fuzzy and "title" in types:
        src = with_fuzzy_query(src, F.col(text_col), kw.get("all_windows", False))
    # the cleaned text feeds several patterns: compute it once per row
    src = src.withColumn("_clean", clean_text(F.col(text_col)))
    raw = _raw_arrays(F.col(text_col), F.col("_clean"), types, kws)
    src = src.withColumns({f"_mx_{t}": a for t, a in raw.items()})
    parts = []
    for t in types:
        v = "regexp_replace(v, '(?U)^\\\\s+|\\\\s+$', '')" if t == "phone" else "v"
        parts.append(f"transform(_mx_{t}, v -> named_struct('type', '{t}', 'value', {v}))")
        if t == "title" and fuzzy:
            src = src.withColumn("_mx_fuzzy", fuzzy_titles_of(kws, kw.get("fuzzy_k", 5), kw.get("fuzzy_min", 30)))
            parts.append("transform(_mx_fuzzy, v -> named_struct('type', 'title', 'value', v))")
    arr = F.expr("concat(" + ", ".join(parts) + ")") if len(parts) > 1 else F.expr(parts[0])
    w = weight if weight is not None else F.lit(None).cast("string")
    c = confidence if confidence is not None else F.lit(None).cast("double")
    out = (src.select(*ids, w.alias("weight"), c.alias("confidence"), F.explode(arr).alias("_m"))
           .select(*ids, F.lit(origin).alias("origin"), "_m.type", "_m.value", "weight", "confidence"))
    return out


def _mentions_by_table(df, table, text_col, ids, origin, types, fuzzy, min_len, weight, confidence, **kw) -> DataFrame:
    """``text_mentions`` with a title dictionary of any size."""
    from sitesift.operators import vocabulary

    df = df.withColumns({"weight": weight if weight is not None else F.lit(None).cast("string"),
                         "confidence": confidence if confidence is not None else F.lit(None).cast("double")})
    src = df if min_len is None else df.filter(long_enough(F.col(text_col)))
    keys = (*ids, "weight", "confidence")
    found = vocabulary.exact_titles(src, F.col(text_col), table, keys).select(*keys, "value")
    if fuzzy:
        found = found.unionByName(vocabulary.fuzzy_titles(
            src, F.col(text_col), table, keys, kw.get("fuzzy_k", 5), kw.get("fuzzy_min", 30),
            kw.get("all_windows", False)).select(*keys, "value"))
    out = found.select(*ids, F.lit(origin).alias("origin"), F.lit("title").alias("type"), "value", "weight", "confidence")
    others = tuple(t for t in types if t != "title")
    if others:
        out = out.unionByName(text_mentions(df, text_col, ids, origin, others, None, False, min_len,
                                            F.col("weight"), F.col("confidence")))
    return out


def wrapper_mention_array(text: Column, titles=None) -> Column:
    """Mentions of one text in the "wrapper" profile: its own patterns; a title is
    the whole text when it contains a keyword."""
    kws = list(WRAPPER_TITLES) if titles is None else keyword_list(titles)
    title = wrapper_title_of(text, kws)
    return F.concat(_typed(wrapper_emails_in(text), "email"), _typed(wrapper_names_in(text), "name"),
                    _typed(wrapper_phones_in(text), "phone"),
                    F.when(title.isNotNull(), F.array(F.struct(F.lit("title").alias("type"), title.alias("value"))))
                    .otherwise(F.array().cast("array<struct<type:string,value:string>>")))


def wrapper_text_mentions(df: DataFrame, text_col: str = "text", ids=("page_id", "url"),
                          origin: str = "text", titles=None) -> DataFrame:
    table = large_dictionary(df.sparkSession, titles)
    if table is not None:
        from sitesift.operators import vocabulary

        rows = df.withColumn("_low", F.lower(text_col))
        told = vocabulary.holding_any(rows.select("_low"), "_low", table.select(F.lower("keyword").alias("keyword"), "ord"))
        found = rows.join(told, "_low", "left_semi").select(*ids, F.lit(origin).alias("origin"), F.lit("title").alias("type"),
                                                            F.col(text_col).alias("value"))
        return found.unionByName(wrapper_text_mentions(df, text_col, ids, origin, titles=[]))
    return (df.select(*ids, F.explode(wrapper_mention_array(F.col(text_col), titles)).alias("_m"))
            .select(*ids, F.lit(origin).alias("origin"), "_m.type", "_m.value"))


def explode_matches(df: DataFrame, text_col: str, pattern: str, group: int = 0,
                    ids=("doc_id",), out: str = "value") -> DataFrame:
    """Generic find-all (X2): one row per non-overlapping match, with its ordinal."""
    from sitesift.functions.text import find_all
    return (df.select(*ids, F.posexplode(find_all(F.col(text_col), pattern, group)).alias("pos", out)))


MENTION = "array<struct<type:string,value:string>>"


def _found_sql(text: str, pattern: str, group: int = 0) -> str:
    from sitesift.functions.text import sql_quote
    return (f"if({text} IS NULL OR {text} = '', cast(array() AS array<string>), "
            f"regexp_extract_all({text}, {sql_quote(pattern)}, {group}))")


def _typed_sql(arr: str, typ: str, value: str = "v") -> str:
    return f"transform({arr}, v -> named_struct('type', '{typ}', 'value', {value}))"


def mentions_of_texts_sql(texts: str, types, titles=None, fuzzy: bool = False, k: int = 5, min_score: int = 30,
                          carry: tuple[str, ...] = ()) -> str:
    """array<struct<type, value>> of the mentions in all texts of an array<string>
    expression. Each text is cleaned once: every step of the chain is an array of
    structs that the next one reads. With ``carry`` the texts are structs of ``text`` and
    these fields, which their mentions take over."""
    from sitesift.functions import patterns as P
    from sitesift.functions.fuzzy import covered_sql, fuzzy_titles_sql, windows_sql

    kws = keyword_list(titles)
    fuzzy = fuzzy and "title" in types and bool(kws)
    kept = lambda x: "".join(f", '{c}', {x}.{c}" for c in carry)
    t, more = "t.text" if carry else "t", kept("s")
    step = f"transform({texts}, t -> named_struct('t', {t}, 'w', trim(regexp_replace({t}, '(?U)\\\\s+', ' ')){kept('t')}))"
    step = f"transform({step}, s -> named_struct('t', s.t, 'c', if(s.w = '', s.t, s.w){more}))"
    if fuzzy:
        step = (f"transform({step}, s -> named_struct('t', s.t, 'c', s.c, 'f', "
                f"filter(split(s.c, ' '), w -> w != ''){more}))")
        step = (f"transform({step}, s -> named_struct('t', s.t, 'c', s.c, 'q', "
                f"trim(regexp_replace(lower({windows_sql('s.f')}), '[^a-z0-9]', ' ')), 'u', "
                f"concat(' ', trim(regexp_replace(lower({covered_sql('s.f')}), '[^a-z0-9]', ' ')), ' '){more}))")
        step = f"transform({step}, s -> named_struct('t', s.t, 'c', s.c, 'q', s.q, 'l', length(s.q), 'u', s.u{more}))"
    parts = []
    for t in types:
        if t == "email":
            parts.append(_typed_sql(_found_sql("s.c", P.EMAIL), t))
        elif t == "name":
            parts.append(_typed_sql(_found_sql("s.t", P.NAME, 1), t))
        elif t == "phone":
            parts.append(_typed_sql(_found_sql("s.c", P.PHONE), t, "regexp_replace(v, '(?U)^\\\\s+|\\\\s+$', '')"))
        elif t == "title":
            if kws:
                parts.append(_typed_sql(_found_sql("s.c", P.title_alternation(kws), 1), t))
            if fuzzy:
                parts.append(_typed_sql(fuzzy_titles_sql(kws, k, min_score, "s.q", "s.l", "s.u"), t))
        else:
            raise ValueError(f"unknown mention type {t}")
    found = f"concat(cast(array() AS {MENTION}), {', '.join(parts)})"
    if carry:
        found = f"transform({found}, m -> named_struct('type', m.type, 'value', m.value{more}))"
    return f"flatten(transform({step}, s -> {found}))"


def wrapper_mentions_of_texts_sql(texts: str, titles=None, carry: tuple[str, ...] = ()) -> str:
    """``wrapper_mention_array`` over all texts of an array<string> expression, or with
    ``carry`` of structs as in ``mentions_of_texts_sql``."""
    from sitesift.functions import patterns as P
    from sitesift.functions.text import holds_any_sql

    kws = [k.lower() for k in (list(WRAPPER_TITLES) if titles is None else keyword_list(titles))]
    t = "t.text" if carry else "t"
    parts = [_typed_sql(_found_sql(t, p), typ)
             for typ, p in (("email", P.EMAIL), ("name", P.WRAPPER_NAME), ("phone", P.WRAPPER_PHONE))]
    if kws:
        parts.append(f"if({holds_any_sql(t, kws)}, "
                     f"array(named_struct('type', 'title', 'value', {t})), cast(array() AS {MENTION}))")
    found = f"concat(cast(array() AS {MENTION}), {', '.join(parts)})"
    if carry:
        fields = "".join(f", '{c}', t.{c}" for c in carry)
        found = f"transform({found}, m -> named_struct('type', m.type, 'value', m.value{fields}))"
    return f"flatten(transform({texts}, t -> {found}))"


class ExtractorRegistry:
    """Plug-in extractors (F1): name -> function(Column) -> array<string>.

    A later registration under the same name replaces the earlier one; a value
    that is not callable is refused; an unknown name gives nothing.
    """

    def __init__(self):
        self._fns = {}
        self._plain = {}

    def register(self, name: str, fn):
        if not callable(fn):
            raise ValueError("extractor must be a function Column -> array<string> column")
        self._plain.pop(name, None)
        self._fns[name] = fn
        return self

    def register_plain(self, name: str, fn):
        """A Python function str -> list of str, run on Arrow batches by ``extract_safely``."""
        if not callable(fn):
            raise ValueError("extractor must be a function str -> list of str")
        self._fns.pop(name, None)
        self._plain[name] = fn
        return self

    def get(self, name: str):
        return self._fns.get(name) or self._plain.get(name)

    def names(self):
        return [*self._fns, *self._plain]

    def extract(self, df: DataFrame, text_col: str = "text", ids=("page_id", "url"),
                names=None) -> DataFrame:
        """Run the named extractors (default: all) over one text column."""
        text = F.col(text_col)
        parts = [_typed(self._fns[n](text), n) for n in (names or self.names()) if n in self._fns]
        if not parts:
            arr = F.array().cast("array<struct<type:string,value:string>>")
        else:
            arr = F.concat(*parts) if len(parts) > 1 else parts[0]
        return df.select(*ids, F.explode(arr).alias("_m")).select(*ids, "_m.type", "_m.value")


    def extract_safely(self, df: DataFrame, text_col: str = "text", ids=("page_id", "url"), names=None) -> DataFrame:
        """(ids..., type, value, level, message): the mentions of the named extractors, and a
        warning for each text on which a Python extractor raised: that extractor gives nothing
        there, the others and the other texts go on. A mention has no level, a warning no
        value; ``extraction_problems`` takes the warnings for the page status. Texts shorter
        than three characters are not searched; what an extractor gives beside strings is
        left out."""
        wanted = [n for n in (names or self.names())]
        rows = df.where(long_enough(F.col(text_col)))
        told = F.lit(None).cast("string")
        out = self.extract(rows, text_col, ids, [n for n in wanted if n in self._fns] or [""]).withColumns({"level": told, "message": told})
        plain = {n: self._plain[n] for n in wanted if n in self._plain}
        if not plain:
            return out
        schema = T.StructType([*rows.select(*ids).schema.fields, *(T.StructField(n, T.StringType()) for n in ("type", "value", "level", "message"))])
        k = len(ids)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                at, found = [], []
                for i, text in enumerate(b.column(k).to_pylist()):
                    for name, fn in plain.items():
                        try:
                            values = [(name, v, None, None) for v in fn(text) or [] if isinstance(v, str)]
                        except Exception as e:  # noqa: BLE001 - one text's failure is that text's warning
                            values = [(name, None, "warning", f"extractor {name} failed: {type(e).__name__}: {str(e)[:200]}")]
                        found += values
                        at += [i] * len(values)
                cols = list(zip(*found)) or [[], [], [], []]
                same = [c.take(pa.array(at, pa.int32())) for c in b.columns[:k]]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, pa.string()) for c in cols)], names=schema.names)

        return out.unionByName(rows.select(*ids, text_col).mapInArrow(run, schema))


def extraction_problems(found: DataFrame, ids=("page_id", "url")) -> DataFrame:
    """The warnings of ``extract_safely`` as problems of the page status."""
    return found.where(F.col("level").isNotNull()).select(*ids, "level", "message")


def default_registry(titles=None) -> ExtractorRegistry:
    kws = keyword_list(titles)
    return (ExtractorRegistry().register("email", emails_in).register("name", names_in)
            .register("phone", phones_in).register("title", lambda c: titles_in(c, kws)))
