"""Profile "contextual" (Q1) and profile "wrapper" (Q2) over a page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesift.dictionaries import OTHER_RANK, TYPE_RANK, large_dictionary
from sitesift.functions.patterns import MIN_TEXT_LEN, V_LINKEDIN
from sitesift.functions.text import sql_quote
from sitesift.operators import structure as S
from sitesift.operators.aggregate import NOT_FOUND, distinct_mentions, union_all
from sitesift.operators.extract import (CONTEXT_TYPES, DIRECT_TYPES, mentions_of_texts_sql, text_mentions,
                                        wrapper_mentions_of_texts_sql, wrapper_text_mentions)
from sitesift.operators.htmltree import parse_pages
from sitesift.session import stored


def parsed_pages(pages: DataFrame, keep: bool = False) -> DataFrame:
    """The parsed page rows. ``keep`` writes them once to the shared folder, for plans
    that read them more than once (the element table is about as large as the HTML)."""
    p = parse_pages(pages)
    return stored(p, "parsed_pages") if keep else p


def contextual_mentions(parsed: DataFrame, titles=None, fuzzy: bool = True, ctx: dict | None = None,
                        phones_everywhere: bool = False, linkedin: bool = True) -> DataFrame:
    """All mention rows of profile "contextual", before de-duplication.

    1. context blocks (class/id keyword, or the element after a keyword header):
       e-mail, name, phone, title, with the block's weight;
    2. vCard and JSON-LD;
    3. e-mail, name, title (phone too with ``phones_everywhere``) over the page
       text, the joined description/keywords meta and each link text (texts
       shorter than 3 characters skipped), plus mailto addresses (confidence 1);
    4. with ``linkedin``, link hrefs that pass the LinkedIn profile pattern
       (the record has a linkedin field that nothing else fills).

    Unless a dictionary is a table, all are found in one pass over the page's row.
    """
    if not isinstance(ctx, DataFrame) and large_dictionary(parsed.sparkSession, titles) is None:
        return _contextual_rows(parsed, titles, fuzzy, ctx, phones_everywhere, linkedin)
    blocks = union_all(
        S.context_blocks(parsed, ctx).select("page_id", "url", "node_id", "weight", "text"),
        S.header_siblings(parsed, ctx).select("page_id", "url", "node_id", "weight", "text"))
    m_ctx = text_mentions(blocks, "text", origin="context", types=CONTEXT_TYPES, titles=titles,
                          fuzzy=fuzzy, min_len=None, weight=F.col("weight"))
    direct = DIRECT_TYPES + (("phone",) if phones_everywhere else ())
    m_text = text_mentions(parsed.select("page_id", "url", "text"), origin="text", types=direct,
                           titles=titles, fuzzy=fuzzy)
    m_meta = text_mentions(parsed.select("page_id", "url", S.meta_joined().alias("text")), origin="meta",
                           types=direct, titles=titles, fuzzy=fuzzy)
    m_link = text_mentions(S.links(parsed), origin="link", types=direct, titles=titles, fuzzy=fuzzy)
    m_vc = S.vcards(parsed).select("page_id", "url", F.lit("vcard").alias("origin"), "type", "value")
    m_js = S.jsonld(parsed).select("page_id", "url", F.lit("jsonld").alias("origin"), "type", "value")
    m_mail = S.mailto(parsed).select("page_id", "url", F.lit("mailto").alias("origin"),
                                     F.lit("email").alias("type"), "value",
                                     F.lit(1.0).alias("confidence"))
    parts = [m_ctx, m_vc, m_js, m_text, m_meta, m_link, m_mail]
    if linkedin:
        from sitesift.operators.validate import validate_linkedin
        parts.append(S.links(parsed).filter(validate_linkedin(F.col("href")).isNotNull()).select(
            "page_id", "url", F.lit("linkedin").alias("origin"), F.lit("linkedin").alias("type"),
            F.col("href").alias("value")))
    return union_all(*parts)


def _contextual_rows(parsed: DataFrame, titles, fuzzy: bool, ctx: dict | None, phones_everywhere: bool,
                     linkedin: bool) -> DataFrame:
    """``contextual_mentions`` with every mention of a page in one array of its row."""
    S.prepare_jsonld(parsed)
    direct = DIRECT_TYPES + (("phone",) if phones_everywhere else ())
    full = lambda arr, origin, typ="m.type", value="m.value", weight="cast(NULL AS string)", conf="cast(NULL AS double)": (
        f"transform({arr}, m -> named_struct('origin', {origin}, 'type', {typ}, 'value', {value}, 'weight', {weight}, "
        f"'confidence', {conf}))")
    parts = {
        "_m_ctx": full(mentions_of_texts_sql(S.weighted_blocks_sql(ctx), CONTEXT_TYPES, titles, fuzzy, carry=("weight",)),
                       "'context'", weight="m.weight"),
        "_m_vcard": full(S.vcard_sql(), "'vcard'"), "_m_json": full(S.jsonld_sql(), "'jsonld'"),
        "_m_text": full(mentions_of_texts_sql(f"filter({S.page_origins_sql()}, t -> length(t.text) >= {MIN_TEXT_LEN})",
                                              direct, titles, fuzzy, carry=("origin",)), "m.origin"),
        "_m_mail": full(S.mailto_sql(), "'mailto'", "'email'", "m", conf="cast(1.0 AS double)"),
    }
    if linkedin:
        parts["_m_linkedin"] = full(f"filter({S.hrefs_sql()}, h -> h RLIKE {sql_quote(V_LINKEDIN)})", "'linkedin'",
                                    "'linkedin'", "m")
    df = parsed.withColumns({k: F.expr(v) for k, v in parts.items()})
    return _mention_rows(df, f"concat({', '.join(parts)})", ("origin", "type", "value", "weight", "confidence"))


def _mention_rows(df: DataFrame, arr: str, fields) -> DataFrame:
    # outer: else the optimizer adds a filter that builds the array a second time
    return (df.select("page_id", "url", F.explode_outer(F.expr(arr)).alias("m")).where("m IS NOT NULL")
            .select("page_id", "url", *(f"m.{f}" for f in fields)))


def contact_array(parsed: DataFrame, titles=None, fuzzy: bool = True, ctx: dict | None = None,
                  phones_everywhere: bool = False, linkedin: bool = True) -> DataFrame:
    """(page_id, url, mentions): the distinct mentions of ``contextual_mentions`` in an
    array of the page's own row, found in one pass over it, without a shuffle."""
    S.prepare_jsonld(parsed)
    direct = DIRECT_TYPES + (("phone",) if phones_everywhere else ())
    pair = lambda arr: f"transform({arr}, m -> named_struct('type', m.type, 'value', m.value))"
    typed = lambda arr, t: f"transform({arr}, v -> named_struct('type', '{t}', 'value', v))"
    parts = {
        "_m_ctx": mentions_of_texts_sql(S.block_texts_sql(ctx), CONTEXT_TYPES, titles, fuzzy),
        "_m_text": mentions_of_texts_sql(f"filter({S.page_texts_sql()}, t -> length(t) >= {MIN_TEXT_LEN})", direct,
                                         titles, fuzzy),
        "_m_vcard": pair(S.vcard_sql()), "_m_json": pair(S.jsonld_sql()), "_m_mail": typed(S.mailto_sql(), "email"),
    }
    if linkedin:
        parts["_m_linkedin"] = typed(f"filter({S.hrefs_sql()}, h -> h RLIKE {sql_quote(V_LINKEDIN)})", "linkedin")
    df = parsed.withColumns({k: F.expr(v) for k, v in parts.items()})
    every = f"filter(concat({', '.join(parts)}), m -> m.value IS NOT NULL AND m.value <> '{NOT_FOUND}')"
    return df.select("page_id", "url", F.expr(f"array_distinct({every})").alias("mentions"))


def contact_info(pages: DataFrame, titles=None, fuzzy: bool = True, ctx: dict | None = None,
                 parsed: DataFrame | None = None, **kw) -> DataFrame:
    """Q1: distinct (page_id, url, type, value) per page. With a title dictionary too long
    for constant expressions, or context keywords as a table, the mentions are found by joins
    and made distinct across the shuffle."""
    if isinstance(ctx, DataFrame) or large_dictionary((pages if parsed is None else parsed).sparkSession, titles) is not None:
        parsed = parsed_pages(pages, keep=True) if parsed is None else parsed
        return distinct_mentions(contextual_mentions(parsed, titles, fuzzy, ctx, **kw))
    parsed = parsed_pages(pages) if parsed is None else parsed
    return (contact_array(parsed, titles, fuzzy, ctx, **kw)
            # outer: else the optimizer adds a filter that builds the array a second time
            .select("page_id", "url", F.explode_outer("mentions").alias("m")).where("m IS NOT NULL")
            .select("page_id", "url", "m.type", "m.value"))


def wrapper_mentions(parsed: DataFrame, titles=None) -> DataFrame:
    """All mention rows of profile "wrapper": each stripped text node, each
    description/keywords meta content, the text of contact elements, and mailto
    hrefs on a/p/div/span; without a dictionary as a table in one pass over the page's row."""
    if large_dictionary(parsed.sparkSession, titles) is None:
        full = lambda arr, origin, typ="m.type", value="m.value": (
            f"transform({arr}, m -> named_struct('origin', {origin}, 'type', {typ}, 'value', {value}))")
        df = parsed.withColumns({
            "_m_text": F.expr(full(wrapper_mentions_of_texts_sql(S.wrapper_origins_sql(), titles, ("origin",)), "m.origin")),
            "_m_mail": F.expr(full(S.mailto_sql(("a", "p", "div", "span")), "'mailto'", "'email'", "m"))})
        return _mention_rows(df, "concat(_m_text, _m_mail)", ("origin", "type", "value"))
    m_nodes = wrapper_text_mentions(S.text_nodes(parsed), origin="text", titles=titles)
    m_meta = wrapper_text_mentions(S.meta_contents(parsed), "content", origin="meta", titles=titles)
    m_ce = wrapper_text_mentions(S.contact_elements(parsed), origin="contact", titles=titles)
    m_mail = S.mailto(parsed, tags=("a", "p", "div", "span")).select(
        "page_id", "url", F.lit("mailto").alias("origin"), F.lit("email").alias("type"), "value")
    return union_all(m_nodes, m_meta, m_ce, m_mail)


def wrapper_info(pages: DataFrame, titles=None, parsed: DataFrame | None = None) -> DataFrame:
    """Q2: distinct (type, value) per page in relevance order (rank, then value, then
    type); ordered and numbered inside the page's row. With a title dictionary too long for
    constant expressions they are found by joins and numbered by a window per page."""
    if large_dictionary((pages if parsed is None else parsed).sparkSession, titles) is not None:
        parsed = parsed_pages(pages, keep=True) if parsed is None else parsed
        found = distinct_mentions(wrapper_mentions(parsed, titles))
        level = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[F.col("type")], F.lit(OTHER_RANK))
        found = found.withColumn("relevance", level)
        order = Window.partitionBy("page_id", "url").orderBy(F.desc("relevance"), "value", "type")
        return found.select("page_id", "url", "type", "value", "relevance", F.row_number().over(order).alias("rn"))
    parsed = parsed_pages(pages) if parsed is None else parsed
    mail = (f"transform({S.mailto_sql(('a', 'p', 'div', 'span'))}, "
            "v -> named_struct('type', 'email', 'value', v))")
    df = parsed.withColumn("_m_text", F.expr(wrapper_mentions_of_texts_sql(S.wrapper_texts_sql(), titles))) \
        .withColumn("_m_mail", F.expr(mail))
    rank = " ".join(f"WHEN '{t}' THEN {r}" for t, r in TYPE_RANK.items())
    order = (f"array_sort(transform(array_distinct(concat(_m_text, _m_mail)), m -> named_struct('neg', "
             f"-(CASE m.type {rank} ELSE {OTHER_RANK} END), 'value', m.value, 'type', m.type)))")
    return (df.select("page_id", "url", F.posexplode_outer(F.expr(order)).alias("pos", "m")).where("m IS NOT NULL")
            .select("page_id", "url", "m.type", "m.value", (-F.col("m.neg")).alias("relevance"),
                    (F.col("pos") + 1).alias("rn")))
