"""Line field, byte network, toxicity model: plain-Python twins and held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sitesift.llm import language_gru as gru
from sitesift.llm import line_crf as crf
from sitesift.llm import toxicity as tox
from sitesift.llm.common import table

SF = "/root/testdata/sf0.01"


# -- line field -------------------------------------------------------------

def plain_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if count[tuple(w[i:i + 8])] > 1:
            hit[i:i + 8] = [True] * 8
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit))


def test_measures():
    rng = random.Random(2)
    texts = ["", "a", "a " * 50, "é\x1c b\x85 \n\n x\n x\nx|", "\n" * 5, "x " * 7 + "y " * 9, "#*$%&|<>" * 3]
    texts += ["".join(rng.choice("ab é\n|#\t\x0b\u2003") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for t in texts:
        assert crf.measures(t.encode()) == plain_measures(t)


def _field(rng):
    return crf.LineCrf(rng.normal(0, 1, crf.N_FEATURES), rng.normal(0, 1, (2, 2)))


def test_viterbi_and_marginals_against_all_label_sequences():
    rng = np.random.default_rng(8)
    for n in range(1, 7):
        f = _field(rng)
        x = rng.normal(0, 1, (n, crf.N_FEATURES))
        s = x @ f.W
        paths = list(itertools.product((0, 1), repeat=n))
        score = [sum(s[i] * y[i] for i in range(n)) + sum(f.T[a, b] for a, b in zip(y, y[1:])) for y in paths]
        assert tuple(f.viterbi(x.tolist())) == paths[int(np.argmax(score))]
        p = np.exp(score) / np.exp(score).sum()
        pad = np.zeros((1, n + 2))
        pad[0, :n] = s
        mask = np.arange(n + 2)[None] < n
        got, steps = f._marginals(pad, mask)
        for i in range(n):
            assert got[0, i] == pytest.approx(sum(q for q, y in zip(p, paths) if y[i]))
        for a, b in itertools.product((0, 1), repeat=2):
            assert steps[a, b] == pytest.approx(
                sum(q * sum((u, v) == (a, b) for u, v in zip(y, y[1:])) for q, y in zip(p, paths)), abs=1e-9)


def test_line_field_keeps_prose_and_drops_boilerplate(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = labels.where("doc_id % 2 = 1")
    got = crf.judge(docs, crf.train(docs, odd)).join(
        labels.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "id"), "id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"]], [r["kept"] for r in got if not r["quality"]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_line_field_without_labels_keeps_by_the_rules_alone(spark):
    docs = spark.createDataFrame([(1, "w " * 9 + "v " * 12, "x"), (2, None, "x"), (3, "", None), (4, "short", "x")],
                                 "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["id"]: (r["base_failed"], r["kept"]) for r in crf.judge(docs, crf.train(docs, none)).collect()}
    assert got[2] == got[3] == got[4] == (True, False) and got[1] == (True, False)


# -- byte network -----------------------------------------------------------

def test_backpropagation_through_time():
    rng = np.random.default_rng(0)
    net = gru.BiGru(["a", "b", "c"])
    for k in "EUVc":
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, y = rng.integers(0, 257, (6, 9)).astype(np.int16), np.array([0, 1, 2, 0, 1, 2])
    _, g = net.gradient(x, y)
    for k in "EUVc":
        w = getattr(net, k)
        for at in [np.unravel_index(np.argmax(np.abs(g[k])), w.shape), tuple(0 for _ in w.shape)]:
            old = w[at]
            w[at] = old + 1e-3
            up = net.gradient(x, y)[0]
            w[at] = old - 1e-3
            down = net.gradient(x, y)[0]
            w[at] = old
            assert (up - down) / 2e-3 == pytest.approx(g[k][at], abs=2e-4)


def test_prediction_covers_the_whole_text(monkeypatch):
    rng = np.random.default_rng(1)
    net = gru.BiGru(["a", "b"])
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 63, 64, 65, 5000)]
    k, p = net.predict(texts)
    for i, t in enumerate(texts):
        if t:       # every window on its own, position by position
            rows = [net.pooled(gru.windows(t)[j:j + 1])[0] for j in range(len(gru.windows(t)))]
            mean = np.sum(rows, axis=0) / len(t)
            assert k[i] == mean.argmax() and p[i] == pytest.approx(mean.max(), abs=1e-5)
    monkeypatch.setattr(gru, "LANES", 3)
    assert np.allclose(net.predict(texts)[1], p, atol=1e-5)


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    net = gru.train(docs, limit=300)
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = gru.predict(docs, net).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == lang[r["id"]] for r in got if r["held_out"] and lang[r["id"]]]
    assert np.mean(held) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "the and that of in")], "doc_id long, text string")
    got = {r["id"]: r for r in gru.predict(odd, net).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[None]["held_out"] is False
    assert got[None]["lang_pred"] in net.classes
    assert gru.keep_known(odd, net, least=0.0).count() == 1
    unlabelled = gru.train(docs.where("false"))
    assert {r["lang_pred"] for r in gru.predict(odd, unlabelled).collect()} == {"und"}


# -- toxicity ---------------------------------------------------------------

def one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_automaton_against_edit_distance():
    rng = random.Random(2)
    for k in range(200):
        terms = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(6)]
        stems = ["".join(rng.choice("abc") for _ in range(4))] if k % 2 else []
        automaton = tox.Automaton(terms, stems)
        for _ in range(40):
            w = list(rng.choice(terms))
            for _ in range(rng.randint(0, 2)):
                i, kind = rng.randrange(len(w) + 1), rng.random()
                if kind < .3:
                    w.insert(i, rng.choice("abcd"))
                elif i < len(w):
                    w[i:i + 1] = [] if kind < .6 else [rng.choice("abcd")]
            w = "".join(w)
            want = (1 if w in terms else 2 if any(w.startswith(s) for s in stems)
                    else 3 if any(len(t) >= tox.FUZZY_FROM and one_edit(w, t) for t in terms) else 0)
            assert automaton.match(w) == want, (terms, stems, w)


def test_quotation_is_told_from_abuse():
    automaton = tox.Automaton(["moronic"], [])
    plain = tox.features("you are a moronic man, so moronik", automaton)
    quoted = tox.features('the word "moronic" is rude', automaton)
    said = tox.features("he said moronic", automaton)
    assert plain[2] > 0 and plain[5] > 0 and plain[6] == 0
    assert quoted[2] == said[2] == 0 and quoted[6] > 0 and said[6] > 0


def test_toxic_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = tox.train(docs, labels)
    mark = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [r for r in tox.score(docs, model).collect() if r["id"] in mark]
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) and
               r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    toxic, other = [r["predicted"] for r in held if mark[r["id"]]], [r["predicted"] for r in held if not mark[r["id"]]]
    assert np.mean(toxic) > 0.6 and np.mean(other) < 0.03
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "İ idiot"), (3, "x" * 200_000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in tox.score(odd, model).collect())
    blank = tox.train(docs, labels.where("false"))
    assert {r["score"] for r in tox.score(odd, blank).collect()} == {0.5}
