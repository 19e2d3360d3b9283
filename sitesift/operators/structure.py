"""Selectors over parsed pages (H2-H12) as array expressions on the page row.

Each operator filters the page's ``elements`` array, computes what it needs
per matching element (its text is a slice of the page text, descendants are
``slice(elements, node_id+2, last_desc-node_id)``, the next sibling is
``elements[next_sib]``) and explodes only the matches. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.dictionaries import CONTEXT_KEYWORDS, all_context_keywords
from sitesift.functions.text import holds_any_sql, lit_array, strip_ws

CONTEXT_BLOCK_TAGS = ["div", "section", "article", "aside", "header", "footer"]
HEADER_TAGS = ["h1", "h2", "h3"]
CONTACT_TAGS = ["a", "p", "div", "span"]


def _explode_struct(parsed: DataFrame, arr: Column, ids=("page_id", "url")) -> DataFrame:
    return parsed.select(*ids, F.explode(arr).alias("_m")).select(*ids, "_m.*")


# ---- SQL-text building blocks ------------------------------------------------------
# Selectors are written as SQL higher-order functions over the page row: a
# Python lambda costs tens of milliseconds to build, a SQL string one parse.
def _q(v: str) -> str:
    from sitesift.functions.text import sql_quote
    return sql_quote(v)


def _etext(x: str) -> str:
    return f"substring(text, {x}.text_start + 1, {x}.text_end - {x}.text_start)"


def _attr(x: str, name: str) -> str:
    return f"coalesce({x}.attrs[{_q(name)}], '')"


def _has_class(x: str, token: str) -> str:
    a = _attr(x, 'class')
    # the attribute is split only where the token stands somewhere in it
    return (f"(instr({a}, {_q(token)}) > 0 AND (array_contains(split({a}, {_q(r'(?U)\s+')}), {_q(token)}) "
            f"OR {a} = {_q(token)}))")


def _in(col: str, values) -> str:
    return f"{col} IN (" + ", ".join(_q(v) for v in values) + ")"


# ---- H2 / H3 / H1 -----------------------------------------------------------

def page_text(parsed: DataFrame, sep: str = "") -> DataFrame:
    """The text of every page; ``sep`` stands between text nodes, as they are."""
    if not sep:
        return parsed.select("page_id", "url", "text")
    nodes = "transform(nodes, tn -> substring(text, tn.start + 1, tn.end - tn.start))"
    return parsed.select("page_id", "url", F.expr(f"array_join({nodes}, {_q(sep)})").alias("text"))


def text_nodes(parsed: DataFrame, stripped: bool = True) -> DataFrame:
    """Text nodes in document order; stripped and non-empty by default."""
    a, b = ("s_start", "s_end") if stripped else ("start", "end")
    cond = "filter(nodes, tn -> tn.s_end > tn.s_start)" if stripped else "nodes"
    arr = F.expr(f"transform({cond}, tn -> named_struct('pos', tn.pos, 'node_id', tn.node_id, "
                 f"'text', substring(text, tn.{a} + 1, tn.{b} - tn.{a})))")
    return _explode_struct(parsed, arr)


def element_rows(parsed: DataFrame) -> DataFrame:
    """The element table: one row per element (H1)."""
    return (parsed.select("page_id", "url", F.explode("elements").alias("e"))
            .select("page_id", "url", "e.node_id", "e.parent_id", "e.sib_idx", "e.next_sib",
                    "e.last_desc", "e.tag", "e.attrs", "e.text_start", "e.text_end"))


# ---- H4 meta --------------------------------------------------------------------

def _desc_meta_pred(x: str) -> str:
    n = f"lower({_attr(x, 'name')})"
    return f"({x}.tag = 'meta' AND (instr({n}, 'description') > 0 OR instr({n}, 'keywords') > 0))"


def meta_contents(parsed: DataFrame) -> DataFrame:
    """One row per description/keywords <meta>: (page_id, url, node_id, content)."""
    arr = F.expr(f"transform(filter(elements, el -> {_desc_meta_pred('el')}), "
                 f"el -> named_struct('node_id', el.node_id, 'content', {_attr('el', 'content')}))")
    return _explode_struct(parsed, arr)


def meta_joined(c_elements: str = "elements") -> Column:
    """All description/keywords contents of a page joined by one space."""
    return F.expr(f"array_join(transform(filter({c_elements}, el -> {_desc_meta_pred('el')}), "
                  f"el -> {_attr('el', 'content')}), ' ')")


# ---- H5 / H6 / H7 links -------------------------------------------------------------

def links(parsed: DataFrame) -> DataFrame:
    """<a> elements with an href: (page_id, url, node_id, text, href), document order."""
    arr = F.expr("transform(filter(elements, el -> el.tag = 'a' AND el.attrs['href'] IS NOT NULL), "
                 f"el -> named_struct('node_id', el.node_id, 'text', {_etext('el')}, 'href', {_attr('el', 'href')}))")
    return _explode_struct(parsed, arr)


HREF_RE = r'href="(.*?)"'


def hrefs_raw(pages: DataFrame) -> DataFrame:
    """Every double-quoted href="..." in the raw HTML by regex (any tag), with position."""
    return (pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF_RE), F.lit(1))))
            .withColumnRenamed("col", "href"))


def mailto(parsed: DataFrame, tags: tuple[str, ...] = ("a",)) -> DataFrame:
    """Addresses of mailto: hrefs (``href[7:]``, query kept) on the given tags."""
    arr = F.expr(f"transform(filter(elements, el -> {_in('el.tag', tags)} AND startswith({_attr('el', 'href')}, 'mailto:')), "
                 f"el -> named_struct('node_id', el.node_id, 'value', substring({_attr('el', 'href')}, 8)))")
    return _explode_struct(parsed, arr)


# ---- H8 contact elements ------------------------------------------------------------

def _contact_pred(x: str) -> str:
    return f"({_in(f'{x}.tag', CONTACT_TAGS)} AND ({_has_class(x, 'contact')} OR instr({_attr(x, 'id')}, 'contact') > 0))"


def contact_elements(parsed: DataFrame) -> DataFrame:
    """a/p/div/span with the class token 'contact' or an id containing 'contact'."""
    arr = F.expr(f"transform(filter(elements, el -> {_contact_pred('el')}), "
                 f"el -> named_struct('node_id', el.node_id, 'text', {_etext('el')}))")
    return _explode_struct(parsed, arr)


# ---- H9 / H10 context blocks --------------------------------------------------------------

def _ctx_lists(ctx):
    ctx = ctx or CONTEXT_KEYWORDS
    kws = [k for ks in ctx.values() for k in ks]
    weights = [w for w, ks in ctx.items() for _ in ks]
    return kws, weights


def context_blocks(parsed: DataFrame, ctx: dict | DataFrame | None = None) -> DataFrame:
    """Block elements whose lower-cased class or id contains a context keyword.

    One row per (element, keyword, attribute): (page_id, url, node_id, keyword,
    weight, ord, via, text). A dict of keywords by weight is a constant array
    evaluated per element, which replaces a nested-loop join with the dictionary. A
    DataFrame (keyword, weight, ord) of any size is joined with the distinct attribute
    values (``vocabulary.containment``).
    """
    if isinstance(ctx, DataFrame):
        from sitesift.operators.vocabulary import keywords_of

        both = ", ".join(f"named_struct('node_id', el.node_id, 'via', '{a}', 'attr', lower({_attr('el', a)}), 'text', {_etext('el')})"
                         for a in ("class", "id"))
        rows = F.expr(f"flatten(transform(filter(elements, el -> {_in('el.tag', CONTEXT_BLOCK_TAGS)}), "
                      f"el -> filter(array({both}), x -> x.attr <> '')))")
        blocks = _explode_struct(parsed, rows)
        told = keywords_of(blocks, "attr", ctx, ("keyword", "weight", "ord"))
        return blocks.join(told, "attr").select("page_id", "url", "node_id", "keyword", "weight", "ord", "via", "text")

    return _explode_struct(parsed, F.expr(context_blocks_sql(ctx)))


def context_blocks_sql(ctx: dict | None = None) -> str:
    """array<struct<node_id, keyword, weight, ord, via, text>> of a page row's context blocks."""
    from sitesift.functions.text import struct_array_sql

    kws, weights = _ctx_lists(ctx)
    hits = struct_array_sql([{"keyword": k, "weight": w, "ord": i} for i, (k, w) in enumerate(zip(kws, weights))])

    def matches(a):
        return (f"transform(filter({hits}, h -> contains(lower({_attr('el', a)}), h.keyword)), "
                f"h -> named_struct('node_id', el.node_id, 'keyword', h.keyword, 'weight', h.weight, "
                f"'ord', h.ord, 'via', {_q(a)}, 'text', {_etext('el')}))")

    blocks = (f"filter(elements, el -> {_in('el.tag', CONTEXT_BLOCK_TAGS)} "
              f"AND ({_attr('el', 'class')} != '' OR {_attr('el', 'id')} != ''))")
    return f"flatten(transform({blocks}, el -> concat({matches('class')}, {matches('id')})))"


def header_siblings(parsed: DataFrame, ctx: dict | DataFrame | None = None) -> DataFrame:
    """Next element sibling of every h1/h2/h3 whose lower-cased text contains a
    context keyword; weight 'high'. (page_id, url, header_id, node_id, weight, text).
    ``ctx`` may be a table as in ``context_blocks``."""
    rows = _explode_struct(parsed, F.expr(header_siblings_sql(ctx)))
    if isinstance(ctx, DataFrame):
        from sitesift.operators.vocabulary import holding_any

        rows = rows.join(holding_any(rows, "head", ctx), "head", "left_semi")
    return rows.select("page_id", "url", "header_id", "node_id", "weight", "text")


def header_siblings_sql(ctx: dict | DataFrame | None = None) -> str:
    """array<struct<header_id, node_id, weight, text, head>> of a page row; with a table of
    keywords, of all its headers."""
    pred = f"{_in('el.tag', HEADER_TAGS)} AND el.next_sib >= 0"
    if not isinstance(ctx, DataFrame):
        pred += f" AND {holds_any_sql(_etext('el'), all_context_keywords(ctx))}"
    sib = "element_at(elements, el.next_sib + 1)"
    return (f"transform(filter(elements, el -> {pred}), el -> named_struct('header_id', el.node_id, "
            f"'node_id', {sib}.node_id, 'weight', 'high', 'text', "
            f"substring(text, {sib}.text_start + 1, {sib}.text_end - {sib}.text_start), 'head', lower({_etext('el')})))")


# ---- H11 vCard ------------------------------------------------------------------------------

VCARD_FIELDS = [("fn", "name"), ("org", "organization"), ("email", "email"), ("tel", "phone")]


def vcards(parsed: DataFrame) -> DataFrame:
    """div.vcard: first descendant with class fn/org/email/tel -> name/organization/email/phone.

    Values are the raw element text (not pattern-checked here)."""
    return _explode_struct(parsed, F.expr(vcard_sql()))


def vcard_sql() -> str:
    """array<struct<node_id, type, value>> of a page row's vCards."""
    desc = "slice(elements, vc.node_id + 2, greatest(vc.last_desc - vc.node_id, 0))"
    fields = ", ".join(
        f"named_struct('node_id', vc.node_id, 'type', {_q(typ)}, 'value', "
        f"element_at(transform(filter({desc}, dd -> {_has_class('dd', cls)}), dd -> {_etext('dd')}), 1))"
        for cls, typ in VCARD_FIELDS)
    return (f"flatten(transform(filter(elements, el -> el.tag = 'div' AND {_has_class('el', 'vcard')}), "
            f"vc -> filter(array({fields}), r -> r.value IS NOT NULL)))")


# ---- H12 JSON-LD ---------------------------------------------------------------------------------

JSONLD_FIELDS = [("name", "name"), ("email", "email"), ("telephone", "phone"), ("jobTitle", "title")]


def prepare_jsonld(df: DataFrame) -> None:
    """Of equal keys in JSON the session keeps the last."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def jsonld_problems(parsed: DataFrame) -> DataFrame:
    """One row (page_id, url, level, message) per JSON-LD script that cannot be parsed."""
    prepare_jsonld(parsed)
    arr = F.expr("transform(filter(elements, el -> el.tag = 'script' AND "
                 f"{_attr('el', 'type')} = 'application/ld+json' AND trim(coalesce(el.raw_text, '')) <> '' "
                 "AND try_parse_json(el.raw_text) IS NULL), "
                 "el -> named_struct('level', 'warning', 'message', 'JSON-LD could not be parsed'))")
    return _explode_struct(parsed, arr)


def jsonld(parsed: DataFrame) -> DataFrame:
    """<script type="application/ld+json">: a list gives its first item; an item whose
    scalar @type is Person or Organization yields name/email/phone/title.
    Of a key given twice the last value counts. Unparseable JSON, an empty script or an
    empty list give no rows (see ``jsonld_problems``)."""
    prepare_jsonld(parsed)
    return _explode_struct(parsed, F.expr(jsonld_sql()))


def jsonld_sql() -> str:
    """array<struct<node_id, type, value>> of a page row's JSON-LD scripts. The session
    must keep the last of equal keys (``prepare_jsonld``)."""
    def scalar(path):
        x = f"try_variant_get(it.v, {_q(path)}, 'variant')"
        return (f"CASE WHEN {x} IS NOT NULL AND NOT rlike(schema_of_variant({x}), '^(OBJECT|ARRAY|VOID|NULL)') "
                f"THEN try_variant_get(it.v, {_q(path)}, 'string') END")
    scripts = (f"filter(elements, el -> el.tag = 'script' AND {_attr('el', 'type')} = 'application/ld+json' "
               "AND el.raw_text IS NOT NULL)")
    parsed = f"transform({scripts}, el -> named_struct('node_id', el.node_id, 'v', try_parse_json(el.raw_text)))"
    items = (f"transform({parsed}, x -> named_struct('node_id', x.node_id, 'v', "
             "CASE WHEN startswith(schema_of_variant(x.v), 'ARRAY') THEN try_variant_get(x.v, '$[0]', 'variant') ELSE x.v END))")
    typ = scalar("$['@type']")
    objects = (f"filter({items}, it -> it.v IS NOT NULL AND startswith(schema_of_variant(it.v), 'OBJECT') "
               f"AND ({typ}) IN ('Person', 'Organization'))")
    rows = ", ".join(f"named_struct('node_id', it.node_id, 'type', '{t}', 'value', {scalar('$.' + k)})"
                     for k, t in JSONLD_FIELDS)
    return f"flatten(transform({objects}, it -> filter(array({rows}), r -> r.value IS NOT NULL)))"


# ---- texts of a page row, for pipelines that search all of them in one pass ----------------

def block_texts_sql(ctx: dict | None = None) -> str:
    """array<string>: texts of context blocks and of siblings of keyword headers."""
    kws = all_context_keywords(ctx)
    told = lambda a: holds_any_sql(_attr("el", a), kws)
    blocks = (f"transform(filter(elements, el -> {_in('el.tag', CONTEXT_BLOCK_TAGS)} AND ({told('class')} OR {told('id')})), "
              f"el -> {_etext('el')})")
    heads = (f"filter(elements, el -> {_in('el.tag', HEADER_TAGS)} AND el.next_sib >= 0 AND "
             f"{holds_any_sql(_etext('el'), kws)})")
    sib = "element_at(elements, el.next_sib + 1)"
    return (f"concat({blocks}, transform({heads}, el -> "
            f"substring(text, {sib}.text_start + 1, {sib}.text_end - {sib}.text_start)))")


def page_texts_sql() -> str:
    """array<string>: page text, joined meta contents, text of every link."""
    meta = (f"array_join(transform(filter(elements, el -> {_desc_meta_pred('el')}), el -> {_attr('el', 'content')}), ' ')")
    ln = "filter(elements, el -> el.tag = 'a' AND el.attrs['href'] IS NOT NULL)"
    return f"concat(array(text, {meta}), transform({ln}, el -> {_etext('el')}))"


def weighted_blocks_sql(ctx: dict | None = None) -> str:
    """array<struct<text, weight>>: texts of context blocks, one for each keyword and attribute
    that tells them, and of siblings of keyword headers."""
    pair = lambda arr: f"transform({arr}, b -> named_struct('text', b.text, 'weight', b.weight))"
    return f"concat({pair(context_blocks_sql(ctx))}, {pair(header_siblings_sql(ctx))})"


def page_origins_sql() -> str:
    """array<struct<text, origin>>: the texts of ``page_texts_sql``."""
    meta = (f"array_join(transform(filter(elements, el -> {_desc_meta_pred('el')}), el -> {_attr('el', 'content')}), ' ')")
    ln = "filter(elements, el -> el.tag = 'a' AND el.attrs['href'] IS NOT NULL)"
    return (f"concat(array(named_struct('text', text, 'origin', 'text'), named_struct('text', {meta}, 'origin', 'meta')), "
            f"transform({ln}, el -> named_struct('text', {_etext('el')}, 'origin', 'link')))")


def wrapper_origins_sql() -> str:
    """array<struct<text, origin>>: the texts of ``wrapper_texts_sql``."""
    nodes = ("transform(filter(nodes, tn -> tn.s_end > tn.s_start), "
             "tn -> named_struct('text', substring(text, tn.s_start + 1, tn.s_end - tn.s_start), 'origin', 'text'))")
    meta = (f"transform(filter(elements, el -> {_desc_meta_pred('el')}), "
            f"el -> named_struct('text', {_attr('el', 'content')}, 'origin', 'meta'))")
    touch = (f"transform(filter(elements, el -> {_contact_pred('el')}), "
             f"el -> named_struct('text', {_etext('el')}, 'origin', 'contact'))")
    return f"concat({nodes}, {meta}, {touch})"


def wrapper_texts_sql() -> str:
    """array<string>: stripped text nodes, meta contents, texts of contact elements."""
    nodes = ("transform(filter(nodes, tn -> tn.s_end > tn.s_start), "
             "tn -> substring(text, tn.s_start + 1, tn.s_end - tn.s_start))")
    meta = f"transform(filter(elements, el -> {_desc_meta_pred('el')}), el -> {_attr('el', 'content')})"
    touch = f"transform(filter(elements, el -> {_contact_pred('el')}), el -> {_etext('el')})"
    return f"concat({nodes}, {meta}, {touch})"


def mailto_sql(tags: tuple[str, ...] = ("a",)) -> str:
    """array<string>: addresses of mailto: hrefs."""
    return (f"transform(filter(elements, el -> {_in('el.tag', tags)} AND startswith({_attr('el', 'href')}, 'mailto:')), "
            f"el -> substring({_attr('el', 'href')}, 8))")


def hrefs_sql() -> str:
    return ("transform(filter(elements, el -> el.tag = 'a' AND el.attrs['href'] IS NOT NULL), "
            f"el -> {_attr('el', 'href')})")


__all__ = [
    "block_texts_sql", "weighted_blocks_sql", "page_texts_sql", "page_origins_sql", "wrapper_origins_sql", "wrapper_texts_sql", "mailto_sql", "hrefs_sql",
    "page_text", "text_nodes", "element_rows",
    "meta_contents", "meta_joined", "links", "hrefs_raw", "mailto", "contact_elements",
    "context_blocks", "header_siblings", "vcards", "vcard_sql", "jsonld", "jsonld_sql", "jsonld_problems", "prepare_jsonld", "strip_ws",
]
