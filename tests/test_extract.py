"""Scalar extraction (FIXTURES F-C) and fuzzy windows."""

import pytest
from pyspark.sql import functions as F

from sitesift.functions.fuzzy import FQ, with_fuzzy_query
from sitesift.functions.text import (clean_text, emails_in, names_in, phones_in, titles_in,
                                     wrapper_phones_in)
from sitesift.operators.validate import validate_email


def one(spark, col_fn, text):
    return spark.createDataFrame([(text,)], "t string").select(col_fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,expected", [
    ("a@b.co|x", ["a@b.co|x"]),                       # D16: the TLD class admits a literal bar
    ("éund.34@m.example.com", [".34@m.example.com"]),
    ("mail a.b@c.d.org, z", ["a.b@c.d.org"]),
])
def test_email(spark, text, expected):
    assert one(spark, emails_in, text) == expected


def test_email_bar_fails_validation(spark):
    assert one(spark, validate_email, "a@b.co|x") is None


@pytest.mark.parametrize("text,expected", [
    ("Email John Doe", ["John Doe"]),
    ("Email Contact John Doe", ["Contact John Doe"]),
    ("Contact Us Today", ["Us Today"]),
    ("Mr. John Smith", ["John Smith"]),
    ("John McDonald", []),
    ("sent by Ann Lee", ["Ann Lee"]),
    ("John Doe Smith", ["John Doe Smith"]),
])
def test_name(spark, text, expected):
    assert one(spark, names_in, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("(123) 456-7890", []),
    ("1234567890", []),
    ("Phone: (123) 456-7890", ["(123) 456-7890"]),
    ("on 2024-01-01 123-456-7890", ["2024-01-01 123-456-7890"]),
])
def test_phone(spark, text, expected):
    assert one(spark, phones_in, text) == expected


def test_wrapper_phone(spark):
    assert one(spark, wrapper_phones_in, "+1 123-456-7890") == ["123-456-7890"]
    assert one(spark, wrapper_phones_in, "Phone: (123) 456-7890") == []


def test_titles_leftmost_then_dictionary_order(spark):
    kws = ["Manager", "Project", "Project Manager"]
    assert one(spark, lambda c: titles_in(c, kws), "our project manager") == ["project", "manager"]
    assert one(spark, lambda c: titles_in(c, ["Project Manager", "Project"]), "our Project Manager") == ["Project Manager"]


def test_clean_text_keeps_blank_input(spark):
    assert one(spark, clean_text, "  a \n\t b  ") == "a b"
    assert one(spark, clean_text, "   ") == "   "


def test_fuzzy_windows_d14(spark):
    # windows start at 0 .. n-4: the last window is never formed
    df = spark.createDataFrame([("a b c d e",), ("a b c",)], "t string")
    got = lambda **kw: [r[FQ] for r in with_fuzzy_query(df, F.col("t"), **kw).collect()]
    assert got() == ["a b c b c d", ""]
    assert got(all_windows=True) == ["a b c b c d c d e", "a b c"]


def test_fuzzy_tiers(spark):
    from sitesift.functions.fuzzy import fuzzy_titles_of, with_fuzzy_query
    df = spark.createDataFrame([("we need a good project lead today now",)], "t string")
    df = with_fuzzy_query(df, F.col("t"))
    got = df.select(fuzzy_titles_of(["Manager", "Lead", "Project Manager", "Project"], k=5)).first()[0]
    # substring hits (60) first in dictionary order, then the shared-word keyword (57)
    assert got == ["Lead", "Project", "Project Manager"]


def test_dictionary_as_dataframe_in_order_and_size_checked(spark, monkeypatch):
    import sitesift.dictionaries as D
    d = spark.createDataFrame([("Manager", 2), ("Project", 1), ("Chief", 0)], "keyword string, ord int")
    assert D.keyword_list(d) == ["Chief", "Project", "Manager"]
    monkeypatch.setattr(D, "MAX_DICTIONARY", 2)
    with pytest.raises(ValueError):
        D.keyword_list(d)


def test_exact_ratio_udf_matches_difflib(spark):
    from difflib import SequenceMatcher

    from sitesift.functions.fuzzy import fuzzy_match
    from sitesift.functions.similarity import ratio_udf
    long = "".join(chr(97 + i * i % 26) for i in range(300))
    pairs = [("Project Manager", "project managers"), ("CEO", "Chief Executive"), ("", "x"), ("abc", "abc"),
             (long, long[::-1] + "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.r for r in df.select(ratio_udf("a", "b").alias("r")).collect()]
    want = [int(round(100 * SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio())) for a, b in pairs]
    assert got == want
    native = [r.m for r in df.select(fuzzy_match(F.col("a"), F.col("b"), 50).alias("m")).collect()]
    assert native[:4] == [True, False, False, True]


def test_names_of_a_very_long_list_of_capitalised_words(spark):
    from sitesift.functions.text import names_in, wrapper_names_in
    words = "Ann " * 50_000
    assert one(spark, names_in, words) == [words.strip()]
    assert one(spark, wrapper_names_in, words) == [words.strip()]
    assert one(spark, names_in, "Ann LeE and Bo McCoy or Jo Li") == ["Jo Li"]


def test_fuzzy_low_cut_off_keeps_short_scores(spark):
    from sitesift.functions.fuzzy import fuzzy_titles_of, with_fuzzy_query
    df = with_fuzzy_query(spark.createDataFrame([("abcde fghij klmno pqrst",)], "t string"), F.col("t"))
    assert df.select(fuzzy_titles_of(["abx", "zz"], 5, 10)).first()[0] == ["abx"]
    assert df.select(fuzzy_titles_of(["abx", "zz"], 5, 30)).first()[0] == []


def test_phones_of_long_digit_runs_take_linear_time(spark):
    from sitesift.functions.text import phones_in
    assert one(spark, phones_in, "1." * 30_000 + "x") == []
    assert one(spark, phones_in, "call +1 (017) 555-0101 or 12+34 212-555-0102") == ["+1 (017) 555-0101", "+34 212-555-0102"]


def test_fuzzy_titles_by_descending_score(spark):
    """Equal to scoring every keyword; edit distance only where fewer than k others were found."""
    import random

    from sitesift.dictionaries import DEFAULT_TITLES
    from sitesift.functions.fuzzy import FQL, FQP, _process_py, fuzzy_titles_sql, tiered_sql, with_fuzzy_query
    from sitesift.functions.text import struct_array_sql

    rnd = random.Random(3)
    words = ["project", "Manager", "manger", "LEAD", "vp", "sales", "of", "ceo", "engineering", "a-b", "Dirctor", "é", "offic", "x."]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(300)] + [None, ""]
    df = with_fuzzy_query(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"))
    kws = [*DEFAULT_TITLES, "", "--", "of the", "a b", "Manager"]
    entries = [{"kw": w, "ord": i, "kp": _process_py(w), "kpl": len(_process_py(w)), "many": len(_process_py(w).split()) > 1,
                "kws": [f" {x} " for x in _process_py(w).split()] or [" "]} for i, w in enumerate(kws)]
    for k, low in ((5, 30), (2, 10), (40, 0), (5, 56), (5, 57), (5, 60)):
        scored = (f"transform({struct_array_sql(entries)}, d -> named_struct('neg', -({tiered_sql(low, qp=FQP)}), "
                  "'ord', d.ord, 'kw', d.kw))")
        every = f"transform(slice(array_sort(filter({scored}, x -> -x.neg > {low})), 1, {k}), x -> x.kw)"
        got = df.select("t", F.expr(every), F.expr(fuzzy_titles_sql(kws, k, low))).collect()
        assert [(r[0], r[1]) for r in got] == [(r[0], r[2]) for r in got]
    # where k keywords are held, no edit distance is worked out: its place is behind the condition
    assert fuzzy_titles_sql(kws).index("levenshtein") > fuzzy_titles_sql(kws).index("size(g) >= 5")


def test_keywords_that_hold_others_are_left_out(spark):
    from sitesift.functions.text import holds_any_sql, wrapper_title_of
    assert "project" not in holds_any_sql("t", ["manager", "project manager"])
    df = spark.createDataFrame([("A Project MANAGER",), ("project",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(wrapper_title_of("t", ["Manager", "Project Manager"])).collect()] == ["A Project MANAGER", None, None, None]


def test_keywords_that_begin_alike_are_tried_together(spark):
    import random

    from sitesift.functions.patterns import title_alternation

    assert title_alternation(["Project Manager", "CEO", "product lead"]).count("ro") == 1      # once, not by keyword
    kws = ["Ab", "aB c", "A", "abc", "a.c", "b(c)d", "b c", "B", "ca", "cab c", "IT", "it is"]
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcAB cd.tiK") for _ in range(14)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _ in range(6):
        some = rng.sample(kws, rng.randint(1, len(kws)))
        plain = "(?iU)\\b(" + "|".join(some) + ")\\b"
        got = df.select(F.regexp_extract_all("t", F.lit(title_alternation(some)), F.lit(1)).alias("a"),
                        F.regexp_extract_all("t", F.lit(plain), F.lit(1)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got)
    for odd in (["a|b", "a c"], ["a+", "ab"], ["(a", "b)"], ["", "a"]):     # patterns are left as they are
        assert title_alternation(odd) == "(?iU)\\b(" + "|".join(odd) + ")\\b"
