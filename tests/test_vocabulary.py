"""Dictionaries as tables against the constant expressions, plain Python and each other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitesift.functions.fuzzy import fuzzy_titles_of, with_fuzzy_query
from sitesift.functions.text import clean_text, titles_in
from sitesift.operators import vocabulary as V


def table(spark, words):
    return spark.createDataFrame([(w, k) for k, w in enumerate(words)], "keyword string, ord long")


def texts_of(spark, texts):
    return spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")


BITS = ["chief", "Officer", "head", "of", "sales", "VP", "project", "manager", "Manager", "é", "Über", "C3PO", "x-ray", "R&D", "(IT)", ",", ".", "  ", "\n", "_a", "ceo", "vice president"]


def words_of(rng, n):
    out = [" ".join(rng.choices(BITS[:14], k=rng.randrange(1, 4))) for _ in range(n)]
    return out + ["R&D", "x-ray", "&D", "R&", "", None, "chief", "CHIEF", "é Über", "-", "head, of", "manager manager"]


def test_whole_words_as_the_alternation_finds_them(spark, monkeypatch):
    rng = random.Random(6)
    words = words_of(rng, 60)
    texts = ["".join(rng.choice(BITS) + rng.choice([" ", " ", "", "-", "\t"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += [None, "", " ", "chief chief chief", "project manager " * 9_000 + "R&D"]        # several pieces
    df = texts_of(spark, texts)
    literal = [re.escape(w) for w in words if w]
    want = df.select("doc_id", F.posexplode(titles_in(F.col("text"), literal)).alias("pos", "value"))
    got = V.exact_titles(df, F.col("text"), table(spark, words), ids=("doc_id",))
    assert got.columns == ["doc_id", "pos", "value"]
    a, b = (sorted((tuple(r) for r in x.collect()), key=str) for x in (got, want))
    assert a == b and len(a) > 10_000
    monkeypatch.setattr(V, "SMALL", 0)       # the dictionary meets the n-grams in a shuffle
    shuffled = V.exact_titles(df, F.col("text"), table(spark, words), ids=("doc_id",))
    assert sorted((tuple(r) for r in shuffled.collect()), key=str) == a
    assert V.exact_titles(df, F.col("text"), table(spark, ["", None]), ids=("doc_id",)).count() == 0
    assert V.exact_titles(df.limit(0), F.col("text"), table(spark, words), ids=("doc_id",)).count() == 0


def test_containment(spark):
    rng = random.Random(7)
    letters = "abcd é\U0001f600"
    texts = ["".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(300)] + [None, "", "ab" * 30_000]
    words = ["".join(rng.choices(letters, k=rng.randrange(7))) for _ in range(200)] + ["", "ab" * 20, "\U0001f600", "zzz"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "_row long, s string")
    got = {(r[0], r[1]) for r in V.containment(df, "s", table(spark, words)).collect()}
    assert got == {(i, k) for i, t in enumerate(texts) for k, w in enumerate(words) if t and w and w in t}
    assert V.containment(df, "s", table(spark, [""])).count() == 0
    plan = V.containment(df, "s", table(spark, words))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("k,low,all_windows", [(5, 30, False), (3, 0, True), (40, 10, False), (2, 57, False)])
def test_fuzzy_as_scoring_every_keyword(spark, k, low, all_windows, monkeypatch):
    rng = random.Random(8)
    words = [w for w in dict.fromkeys(words_of(rng, 150)) if w] + ["a" * 60, "sales mgr", "hed of salse", "...", "projekt menager"]
    texts = [" ".join(rng.choices([*BITS[:14], "hed", "salse", "mgr", "of the"], k=rng.randrange(2, 9))) for _ in range(120)]
    texts += [None, "", "a b c d", " ".join(rng.choices(BITS, k=4000)), "nothing alike here at all", "zzz yyy xxx www"]
    df = texts_of(spark, texts)
    staged = with_fuzzy_query(df, F.col("text"), all_windows)
    want = staged.select("doc_id", F.posexplode(fuzzy_titles_of(words, k, low)).alias("rk", "value"))
    got = V.fuzzy_titles(df, F.col("text"), table(spark, words), ids=("doc_id",), k=k, min_score=low, all_windows=all_windows)
    a = sorted(((r["doc_id"], r["rk"] - 1, r["value"]) for r in got.collect()), key=str)
    assert a == sorted((tuple(r) for r in want.collect()), key=str) and a
    scores = sorted((tuple(r) for r in got.collect()), key=str)
    monkeypatch.setattr(V, "MATCHER", 0)          # joined instead
    joined = V.fuzzy_titles(df, F.col("text"), table(spark, words), ids=("doc_id",), k=k, min_score=low, all_windows=all_windows)
    assert sorted((tuple(r) for r in joined.collect()), key=str) == scores


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
        return row[-1]
    rng = random.Random(9)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(90 if rng.random() < 0.1 else 9))) for _ in range(2))
        assert V.edit_distance(a, b) == plain(a, b)


def test_profiles_take_long_dictionaries(spark, pages_of, monkeypatch):
    """The same mentions, whether a dictionary is compiled into constants or joined."""
    from conftest import FA, FB, FB_TITLES

    from sitesift import dictionaries
    from sitesift.operators.crawl import with_relevance
    from sitesift.operators.htmltree import parse_pages
    from sitesift.operators.structure import context_blocks, header_siblings
    from sitesift.plans.contact import contact_info, wrapper_info

    pages = pages_of(FA, FB, "", "<p>Project   Manager of IT, vp</p><h2>Staff</h2><p>Chief Officer</p>")
    titles = [t for t in FB_TITLES if t != "Dr."] + ["chief", "director"]      # "Dr." is a pattern, not literal text
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    small = [rows(contact_info(pages, titles=titles)), rows(wrapper_info(pages, titles=titles))]
    monkeypatch.setattr(dictionaries, "MAX_DICTIONARY", 3)
    with pytest.raises(ValueError):
        dictionaries.keyword_list(titles)
    assert [rows(contact_info(pages, titles=titles)), rows(wrapper_info(pages, titles=table(spark, titles)))] == small
    ctx = spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(
        (k, w) for w, ks in dictionaries.CONTEXT_KEYWORDS.items() for k in ks)], "keyword string, weight string, ord int")
    parsed = parse_pages(pages)
    assert rows(context_blocks(parsed, ctx)) == rows(context_blocks(parsed)) != []
    assert rows(header_siblings(parsed, ctx)) == rows(header_siblings(parsed)) != []
    links = spark.createDataFrame([("http://a/team/x", "our board"), ("http://a/", None), ("http://a/x/y/z", "news"), ("http://a/x/y/z", "")], "url string, text string")
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(dictionaries.URL_KEYWORDS)], "keyword string, ord int")
    assert rows(with_relevance(links, "url", "text", keywords=keys)) == rows(with_relevance(links, "url", "text"))


def test_substrings_meet_few_keywords_they_do_not_hold(spark):
    """Digits share their 3-grams: numbers met every keyword with a common gram."""
    from sitesift.operators.vocabulary import containment, keywords_of, holding_any

    numbers = [str(i) for i in range(0, 3000, 7)]
    long_ = "x" * 100 + "END"
    words = numbers + ["ab", "é", "box-", long_, "x" * 70]
    texts = ["box-123456", "n777", "ab ab ab", "zéz", "x" * 150 + "END", "y" * 1020 + "box-14" + "y" * 2000 + "box-", "", "q"]
    kw = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "keyword string, ord long")
    tx = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row long, s string")
    want = sorted((i, k) for i, t in enumerate(texts) for k, w in enumerate(words) if w in t)
    assert sorted((r[0], r[1]) for r in containment(tx, "s", kw).collect()) == want
    got = sorted((r.s, r.keyword) for r in keywords_of(tx, "s", kw).collect())
    assert got == sorted((texts[i], words[k]) for i, k in want)
    assert sorted(r.s for r in holding_any(tx, "s", kw).collect()) == sorted({texts[i] for i, _ in want})

    many = spark.range(4000).selectExpr("cast(1000000 + id * 7919 % 1000000 AS string) AS keyword", "id AS ord")
    some = spark.range(400).selectExpr("id AS _row", "'k' || cast(1000000 + id * 4999 % 1000000 AS string) AS s")
    # equal substrings need no check: no pairs that share a gram alone are made
    assert "contains(" not in containment(some, "s", many)._jdf.queryExecution().executedPlan().toString().lower()


def walked_plainly(texts, words):
    """Matches token by token: (text, pos, value)."""
    import regex

    orders, out = {}, []
    for order, w in enumerate(words):
        orders.setdefault(w.lower(), order)
    tokens = lambda t: regex.findall(V.TOKEN, t)
    longest, is_word = max(len(tokens(w)) for w in words), lambda c: bool(regex.match(rf"[{V._WORD}]", c))
    for row, t in enumerate(texts):
        toks, i, pos = tokens(t), 0, 0
        low = [x.lower() for x in toks]
        while i < len(toks):
            fits = [(orders[g], m) for m in range(1, min(longest, len(toks) - i) + 1) if (g := "".join(low[i:i + m])) in orders
                    and (is_word(toks[i]) or (i and is_word(toks[i - 1]))) and (is_word(toks[i + m - 1]) or (i + m < len(toks) and is_word(toks[i + m])))]
            if fits:
                m = min(fits)[1]
                out.append((row, pos, "".join(toks[i:i + m])))
                i, pos = i + m, pos + 1
            else:
                i += 1
    return out


def test_walk_of_any_signs(spark):
    rng = random.Random(12)
    signs = ["Σ", "σ", "ς", "Α", "İ", "i", "̇", "K", "é", "É", "ß", "x", "X", "\U0001f600", "\U00010400", "\U00010428", "-", ".", " ", "\0", "_", "9", "語"]
    words = list(dict.fromkeys(w for n in (1, 1, 2, 3, 4) for w in ("".join(rng.choices(signs, k=n)) for _ in range(60))))
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(500)] + ["", "é x" * 90_000]
    grams = list(dict.fromkeys(w.lower() for w in words))
    import regex
    tokens = [regex.findall(V.TOKEN, g) for g in grams]
    orders = [next(k for k, w in enumerate(words) if w.lower() == g) for g in grams]
    walker = V.Walker(grams, orders, [t[0] for t in tokens], [len(t) for t in tokens])
    want = walked_plainly(texts, words)
    assert sorted(zip(*walker.walk(texts))) == want and len(want) > 2_000
    none = V.Walker([], [], [], [])
    assert none.walk(texts) == ([], [], []) and walker.walk([""]) == ([], [], [])


def test_dictionary_of_over_a_million_keywords_meets_texts_without_joins(spark):
    """Over 64 MB every n-gram of every text was written for a join."""
    words = spark.range(1_100_000).selectExpr("'No ' || CAST(id AS string) AS keyword", "id AS ord")
    df = texts_of(spark, ["see no 7, No 1099999 and no 1100000 or NO  8", None])
    got = V.exact_titles(df, F.col("text"), words, ids=("doc_id",))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pos, r.value) for r in got.collect()) == [(0, "no 7"), (1, "No 1099999"), (2, "NO 8")]


def test_keywords_behind_the_first_ones(spark, monkeypatch):
    """The same answers, however few keywords the automata hold; over 8 MB of characters every
    place of every text went into joins."""
    rng = random.Random(21)
    words = [(k, w, re.sub("[^a-z0-9]", " ", w.lower()).strip()) for k, w in enumerate(words_of(rng, 300)) if w]
    words = [x for x in words if x[2]] + [(1000, "a" * 60, "a" * 60), (1001, "R - & D", "r     d"), (1002, "of", "of"), (1003, "OF", "of"), (1004, "e", "e"), (1005, "f s", "f s")]
    texts = [" ".join(rng.choices([*BITS, "hed", "salse", "of the", "İT"], k=rng.randrange(12))) for _ in range(200)] + ["", "x " * 5000, "r - & d - e" * 3]
    queries = [V.fuzzy_query(clean, all_windows=True) for clean in texts]

    def plainly(q, k):
        score = lambda kp: 60 if kp in q else 57 if " " in kp and set(kp.split()) & set(q.split()) else 0
        scored = sorted((-score(kp), i) for i, (_, _, kp) in enumerate(words))
        return [(i, -s) for s, i in scored if q and -s > 56][:k]

    for k in (1, 5, 40):
        for early in ((1 << 11, 1 << 14), (2, 9), (0, 0)):
            monkeypatch.setattr(V, "EARLY", early)
            kept, seen = [], {}
            for x in words:                              # alike ones count k times
                seen[x[2]] = seen.get(x[2], 0) + 1
                if seen[x[2]] <= k:
                    kept.append(x)
            got = V.Matcher(kept, k).best(queries, 56)
            want = [[(words[i], s) for i, s in plainly(q, k)] for q in queries]
            assert [[(kept[i], s) for i, s in x] for x in got] == want
    assert sum(map(len, want)) > 500
    many = spark.range(700_000).selectExpr("'number ' || CAST(id AS string) AS keyword", "id AS ord")
    df = texts_of(spark, ["the number 699999 of all 5 numbers"])
    titles = V.fuzzy_titles(df, F.col("text"), many, ids=("doc_id",))
    assert "Join" not in titles._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in titles.orderBy("rk").collect()] == [(r, f"number {x}", 60) for r, x in enumerate((6, 69, 699, 6999, 69999), 1)]


def test_dictionaries_are_broadcast_as_plain_data():
    """Executors need no install of the package: nothing in a broadcast names its classes."""
    import pickle

    walker = V.Walker(["a b", "c"], [1, 0], ["a", "c"], [3, 1])
    matcher = V.Matcher([(0, "a b", "a b"), (1, "c", "c")], 5)
    data = [pickle.dumps(V._as_data(x)) for x in (walker, matcher)]
    assert not any(b"sitesift" in x for x in data)
    assert V._from_data(pickle.loads(data[0])).walk(["c, A b"]) == ([0, 0], [0, 1], ["c", "A b"])
    assert V._from_data(pickle.loads(data[1])).best(["a b c"], 30) == [[(0, 60), (1, 60)]]
