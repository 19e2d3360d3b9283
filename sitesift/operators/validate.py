"""Validation of contact fields and records (V1-V7).

Name and title validation use a token table ``tokens(value, i, text, pos,
ent_label, ent_id)`` that any tagger can supply. ``rule_tokens`` is a small
rule-based stand-in used when no tagger output is given; it is ours and is not
a statistical tagger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.dictionaries import keyword_list
from sitesift.functions import patterns as P
from sitesift.functions.text import lit_array, sql_quote
from sitesift.session import stored

RECORD_FIELDS = ["email", "name", "linkedin", "title", "phone"]


def validate_email(c: Column) -> Column:
    return F.when(c.rlike(P.V_EMAIL), c)


def validate_phone(c: Column) -> Column:
    return F.when(c.rlike(P.V_PHONE), c)


def validate_linkedin(c: Column) -> Column:
    return F.when(c.rlike(P.V_LINKEDIN), c)


NAME_RULE = r"^[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}$"


def validate_name_rule(c: Column, titles=None) -> Column:
    """Stand-in for a PERSON entity: 2-4 capitalized words, none a title keyword."""
    kws = lit_array([k.lower() for k in keyword_list(titles)])
    words = F.split(F.lower(c), " ")
    return F.when(c.rlike(NAME_RULE) & ~F.exists(words, lambda w: F.array_contains(kws, w)), c)


# --- rule tagger (stand-in) -----------------------------------------------------
# --- FIXED VALUES (ours): a few function words and adjectives for the stand-in tagger ---
DETERMINERS = ["the", "a", "an", "this", "that", "our", "your"]
ADJECTIVES = ["senior", "junior", "chief", "general", "executive", "principal", "lead", "head",
              "assistant", "associate", "technical", "regional", "global", "national", "new"]


def rule_tokens(values: DataFrame, value_col: str = "value", titles=None) -> DataFrame:
    """Token table for distinct values: POS by rule, PERSON entity when the whole
    value passes ``validate_name_rule``."""
    v = values.select(F.col(value_col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    t = v.select("value", F.posexplode(F.split("value", " ")).alias("i", "text")).filter(F.col("text") != "")
    low = F.lower("text")
    pos = (F.when(low == "of", "ADP").when(low.isin(*DETERMINERS), "DET")
           .when(low.endswith("ly"), "ADV").when(low.isin(*ADJECTIVES), "ADJ")
           .when(F.col("text").rlike("^[A-Z]"), "PROPN").otherwise("NOUN"))
    person = validate_name_rule(F.col("value"), titles).isNotNull()
    return t.select("value", "i", "text", pos.alias("pos"),
                    F.when(person, F.lit("PERSON")).alias("ent_label"),
                    F.when(person, F.lit("e0")).alias("ent_id"))


def entity_names(tokens: DataFrame) -> DataFrame:
    """V3 from annotations: first PERSON entity text of each value."""
    ents = (tokens.filter(F.col("ent_label").isNotNull())
            .groupBy("value", "ent_id", "ent_label")
            .agg(F.min("i").alias("i0"), F.array_join(F.transform(F.array_sort(
                F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), " ").alias("ent_text")))
    return (ents.filter(F.col("ent_label") == "PERSON").groupBy("value")
            .agg(F.min_by("ent_text", "i0").alias("valid_name")))


def title_spans(tokens: DataFrame) -> DataFrame:
    """V5: first span matching PROPN 'of' PROPN | ADJ NOUN | NOUN NOUN (earliest
    start, then shortest) -> (value, valid_title, span_i, span_last): the span
    text and the positions of its first and last token."""
    w = Window.partitionBy("value").orderBy("i")
    t = tokens.select("value", "i", "text", "pos",
                      F.lead("pos", 1).over(w).alias("p1"), F.lead("pos", 2).over(w).alias("p2"),
                      F.lead("text", 1).over(w).alias("t1"), F.lead("text", 2).over(w).alias("t2"),
                      F.lead("i", 1).over(w).alias("i1"), F.lead("i", 2).over(w).alias("i2"))
    two = ((F.col("pos") == "ADJ") & (F.col("p1") == "NOUN")) | ((F.col("pos") == "NOUN") & (F.col("p1") == "NOUN"))
    three = (F.col("pos") == "PROPN") & (F.lower("t1") == "of") & (F.col("p2") == "PROPN")
    cand = t.select("value", "i",
                    F.when(two, F.lit(2)).when(three, F.lit(3)).alias("n"),
                    F.when(two, F.concat_ws(" ", "text", "t1"))
                    .when(three, F.concat_ws(" ", "text", "t1", "t2")).alias("span"),
                    F.when(two, F.col("i1")).when(three, F.col("i2")).alias("last"))
    best = F.min_by(F.struct("span", "i", "last"), F.struct("i", "n"))
    return (cand.filter(F.col("n").isNotNull()).groupBy("value").agg(best.alias("b"))
            .select("value", F.col("b.span").alias("valid_title"), F.col("b.i").alias("span_i"),
                    F.col("b.last").alias("span_last")))


def org_from_titles(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """V6 (title part): for (title, name, span_i, span_last) the first PROPN token
    inside the validated span whose text is not part of the validated name."""
    p = tokens.filter(F.col("pos") == "PROPN").select(F.col("value").alias("_pv"), F.col("i").alias("_pi"),
                                                     F.col("text").alias("_pt"))
    j = pairs.join(p, (F.col("title") == F.col("_pv")) & (F.col("_pi") >= F.col("span_i"))
                   & (F.col("_pi") <= F.col("span_last")))
    j = j.filter(~(F.instr(F.coalesce(F.col("name"), F.lit("")), F.col("_pt")) > 0))
    return j.groupBy("title", "name").agg(F.min_by("_pt", "_pi").alias("title_org"))


def _rule_tokens_sql(value: str) -> str:
    """array<struct<text, pos>> of one value by the stand-in tagger's rules."""
    words = lambda ws: ", ".join(sql_quote(w) for w in ws)
    pos = (f"CASE WHEN lower(t) = 'of' THEN 'ADP' WHEN lower(t) IN ({words(DETERMINERS)}) THEN 'DET' "
           f"WHEN endswith(lower(t), 'ly') THEN 'ADV' WHEN lower(t) IN ({words(ADJECTIVES)}) THEN 'ADJ' "
           "WHEN t RLIKE '^[A-Z]' THEN 'PROPN' ELSE 'NOUN' END")
    return (f"transform(filter(split({value}, ' '), t -> t <> ''), t -> named_struct('text', t, 'pos', {pos}))")


def _span_org_sql(tokens: str, name: str) -> str:
    """struct<sp: struct<span, at, n>, org> of a title's tokens: V5, the first span as its text,
    position and length; V6 (title part), the first PROPN token inside the span that is not
    part of the name. One-item arrays stand for names, so that each step is an array that the
    next one reads: a column named in a step may be put in its place wherever it is read."""
    span = """if(size(tk) > 0, get(filter(transform(sequence(1, size(tk)), j -> CASE
        WHEN get(tk, j).pos = 'NOUN' AND get(tk, j - 1).pos IN ('ADJ', 'NOUN')
        THEN named_struct('span', concat_ws(' ', get(tk, j - 1).text, get(tk, j).text), 'at', j, 'n', 2)
        WHEN get(tk, j - 1).pos = 'PROPN' AND lower(get(tk, j).text) = 'of' AND get(tk, j + 1).pos = 'PROPN'
        THEN named_struct('span', concat_ws(' ', get(tk, j - 1).text, get(tk, j).text, get(tk, j + 1).text), 'at', j, 'n', 3)
        END), x -> x IS NOT NULL), 0), NULL)"""
    org = f"get(filter(slice(tk, sp.at, sp.n), x -> x.pos = 'PROPN' AND instr(coalesce({name}, ''), x.text) = 0), 0).text"
    return (f"transform(array({tokens}), tk -> transform(array({span}), "
            f"sp -> named_struct('sp', sp, 'org', {org}))[0])[0]")


def _key(col: str) -> Column:
    """``col``, or for a null one of 1,024 values that no value equals: rows without the
    field, most of a sparse table, are not gathered in one task by a join."""
    spread = F.pmod(F.xxhash64("src_url", *RECORD_FIELDS), F.lit(1024)).cast("string")
    return F.coalesce(F.col(col), F.concat(F.lit("\u0000"), spread))


def validate_records(records: DataFrame, tokens: DataFrame | None = None, titles=None) -> DataFrame:
    """V1-V7 on sparse records (email, name, linkedin, title, phone, src_url).

    Null-safe and single pass. Organization enrichment (V6): an ORG entity of
    the validated name, overridden by the first PROPN token of the validated
    title span that is not part of the name. A record is kept when any
    validated field is non-null. Without a token table the stand-in tagger works on
    the row's own values and nothing is joined; with one, names and titles are looked
    up in it.
    """
    r = records
    for f in RECORD_FIELDS + ["organization"]:
        if f not in r.columns:
            r = r.withColumn(f, F.lit(None).cast("string"))
    r = r.select(*RECORD_FIELDS, "organization", "src_url")
    if tokens is None:
        r = r.withColumn("name_org", F.lit(None).cast("string"))
        found, valid = _rule_tokens_sql("title"), validate_name_rule(F.col("name"), titles)
    else:
        tokens = stored(tokens.select("value", "i", "text", "pos", "ent_label", "ent_id"), "tokens")
        ordered = F.array_sort(F.collect_list(F.struct("i", "text", "pos")))
        of_title = tokens.groupBy(F.col("value").alias("_k")).agg(
            F.transform(ordered, lambda x: F.struct(x["text"].alias("text"), x["pos"].alias("pos"))).alias("_tk"))
        entity = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ")
        orgs = (tokens.filter(F.col("ent_label") == "ORG").groupBy("value", "ent_id")
                .agg(F.min("i").alias("i0"), entity.alias("t"))
                .groupBy(F.col("value").alias("_k")).agg(F.max_by("t", "i0").alias("name_org")))
        names = entity_names(tokens).withColumnRenamed("value", "_k")
        r = r.withColumn("_k", _key("name")).join(names, "_k", "left").drop("_k")
        r = r.withColumn("_k", _key("title")).join(of_title, "_k", "left").drop("_k")
        # ORG entities are looked up on the validated name text (what gets re-tagged)
        r = r.withColumn("_k", _key("valid_name")).join(orgs, "_k", "left").drop("_k")
        found, valid = "_tk", F.col("valid_name")
    r = r.withColumn("name", valid)
    kept = F.struct(validate_email(F.col("email")).alias("email"), F.col("name"), validate_linkedin(F.col("linkedin")).alias("linkedin"),
                    F.expr(f"if(title IS NULL, NULL, {_span_org_sql(found, 'name')})").alias("of"),
                    validate_phone(F.col("phone")).alias("phone"), F.coalesce("name_org", "organization").alias("org"), "src_url")
    told = " OR ".join(f"r.{f} IS NOT NULL" for f in ("email", "name", "linkedin", "of.sp.span", "phone"))
    # a generator's output: else the optimizer puts the expressions into the filter a second time
    r = r.select(F.array(kept).alias("_r")).select(F.explode_outer(F.expr(f"filter(_r, r -> {told})")).alias("r")).where("r IS NOT NULL")
    return r.select("r.email", "r.name", "r.linkedin", F.col("r.of.sp.span").alias("title"), "r.phone",
                    F.coalesce("r.of.org", "r.org").alias("organization"), "r.src_url")
