"""Token-table validation (FIXTURES F-F)."""

from sitesift.operators.validate import entity_names, org_from_titles, title_spans, validate_records

TOKENS = [
    ("Director of Sales", 0, "Director", "PROPN", None, None), ("Director of Sales", 1, "of", "ADP", None, None),
    ("Director of Sales", 2, "Sales", "PROPN", None, None),
    ("senior engineer", 0, "senior", "ADJ", None, None), ("senior engineer", 1, "engineer", "NOUN", None, None),
    ("the project manager here", 0, "the", "DET", None, None), ("the project manager here", 1, "project", "NOUN", None, None),
    ("the project manager here", 2, "manager", "NOUN", None, None), ("the project manager here", 3, "here", "ADV", None, None),
    ("quickly", 0, "quickly", "ADV", None, None),
    ("Ana Ruiz", 0, "Ana", "PROPN", "PERSON", "e1"), ("Ana Ruiz", 1, "Ruiz", "PROPN", "PERSON", "e1"),
    ("Acme", 0, "Acme", "PROPN", "ORG", "e2"),
]
SCHEMA = "value string, i int, text string, pos string, ent_label string, ent_id string"


def test_title_spans(spark):
    t = spark.createDataFrame(TOKENS, SCHEMA)
    got = {r.value: r.valid_title for r in title_spans(t).collect()}
    assert got == {"Director of Sales": "Director of Sales", "senior engineer": "senior engineer",
                   "the project manager here": "project manager"}


def test_person_entities(spark):
    t = spark.createDataFrame(TOKENS, SCHEMA)
    assert {r.value: r.valid_name for r in entity_names(t).collect()} == {"Ana Ruiz": "Ana Ruiz"}


def test_records_with_annotations(spark):
    t = spark.createDataFrame(TOKENS, SCHEMA)
    recs = spark.createDataFrame([
        (None, "Ana Ruiz", None, "Director of Sales", None, "u1"),
        (None, "Acme", None, "quickly", None, "u2"),
        (None, None, None, "senior engineer", None, "u3"),
    ], "email string, name string, linkedin string, title string, phone string, src_url string")
    got = {r.src_url: r for r in validate_records(recs, tokens=t).collect()}
    assert got["u1"].title == "Director of Sales" and got["u1"].organization == "Director"
    assert "u2" not in got                         # name without PERSON, no title span: invalid, no error
    assert got["u3"].title == "senior engineer" and got["u3"].organization is None


def test_org_not_taken_from_the_name(spark):
    t = spark.createDataFrame(TOKENS, SCHEMA)
    pairs = spark.createDataFrame([("Director of Sales", "Sales Director", 0, 2)],
                                  "title string, name string, span_i int, span_last int")
    assert org_from_titles(pairs, t).collect() == []


def test_pattern_validators_are_idempotent(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from pyspark.sql import functions as F

    from sitesift.operators.validate import validate_email, validate_linkedin, validate_phone

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.one_of(st.from_regex(r"[a-z.]{1,6}@[a-z]{1,5}\.[a-z|]{1,4}", fullmatch=True),
                              st.from_regex(r"\+?[0-9 .()-]{7,16}", fullmatch=True),
                              st.from_regex(r"https?://(www\.)?linkedin\.com/in/[a-z-]{0,6}/?", fullmatch=True)),
                    min_size=1, max_size=6))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        for f in (validate_email, validate_phone, validate_linkedin):
            once = df.select(f(F.col("v")).alias("v"))
            a = [r.v for r in once.collect()]
            b = [r.v for r in once.select(f(F.col("v")).alias("v")).collect()]
            assert a == b

    check()


def test_a_title_is_tokenized_once(spark):
    recs = spark.createDataFrame(
        [(None, "Ana Lee", "Director of Sales", "u1"), (None, "Ana Director", "Director of Sales", "u2"), (None, None, "quickly", "u3"),
         ("a@b.co", None, "the project manager here", "u4"), (None, None, "senior engineer", "u5"), ("bad", None, None, "u6")],
        "email string, name string, title string, src_url string")
    v = validate_records(recs, titles=["Manager"])
    assert {r["src_url"]: (r["email"], r["name"], r["title"], r["organization"]) for r in v.collect()} == {
        "u1": (None, "Ana Lee", "Director of Sales", "Director"), "u2": (None, "Ana Director", "Director of Sales", "Sales"),
        "u4": ("a@b.co", None, "project manager", None), "u5": (None, None, "senior engineer", None)}
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(title") == 1 and plan.count("sequence(") == 1


def test_name_entities_read_their_pages_once(spark):
    from sitesift.plans.checks import QUERIES
    from sitesift.session import scratch_path

    d = scratch_path(spark, "names")
    spark.createDataFrame([(k, f"Customer#{k}", k % 2, "BUILDING") for k in range(1, 9)],
                          "c_custkey long, c_name string, c_nationkey long, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(0, "PERU"), (1, "CHINA")], "n_nationkey long, n_name string").write.parquet(f"{d}/nation.parquet")
    found = QUERIES["v_name_entities"](spark, d)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()      # the parse of the pages
    assert ("Ana Building", "Ana Building") in {tuple(r) for r in found.collect()}
