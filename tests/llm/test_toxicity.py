"""Toxicity: misspelled short terms, digits and symbols inside words."""

import random

from sitesift.llm import toxicity as tox

TERMS = ["scum", "idiot", "moron", "loser", "clown", "stupid"]


def near(a, b):
    """One insertion, deletion, substitution or swap of neighbours apart, by trying all."""
    alphabet = set(a + b)
    forms = {b[:i] + b[i + 1:] for i in range(len(b))}
    forms |= {b[:i] + c + b[i + k:] for i in range(len(b) + 1) for k in (0, 1) for c in alphabet}
    forms |= {b[:i] + b[i + 1] + b[i] + b[i + 2:] for i in range(len(b) - 1)}
    return a in forms


def test_short_terms_may_be_misspelled():
    automaton = tox.Automaton(TERMS, [])
    for w in ("idoit", "moorn", "losser", "scumm", "clwn"):
        assert automaton.match(w) == automaton.FUZZY
    rng = random.Random(5)
    for _ in range(3000):
        w = list(rng.choice(TERMS))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "1", "*", "o"])
        w = "".join(w)
        want = 1 if w in TERMS else 3 if any(near(w, t) for t in TERMS) else 0
        assert automaton.match(w) == want, w


def test_digits_and_symbols_inside_words():
    automaton = tox.Automaton(TERMS, [])
    for form in ("id1ot", "st*pid", "m0ron", "l_ser", "sc.um"):
        assert tox.features(f"you are a {form}, really", automaton)[5] > 0, form
    parts = tox.features("idiot-loser, moron's (clown)", automaton)
    assert parts[2] > 1.6 and parts[5] == 0
    assert tox.features("a.b.c 1x2 x" + "y" * 100_000, automaton)[5] == 0


def test_misspelled_abuse_is_toxic_and_ordinary_near_words_are_not(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(600):
        words = [rng.choice(["river", "stone", "table", "window", "letter", "garden", "crown"]) for _ in range(30)]
        bad = k % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(30), rng.choice(["clown", "moron", "idiot"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    model = tox.train(spark.createDataFrame(docs, "doc_id long, text string"),
                      spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"clown", "moron", "idiot"} <= set(model.terms) and "crown" in model.ordinary
    texts = ["river stone idoit table moorn letter", "garden m0ron window id1ot stone", "river crown stone crown letter"]
    a, b, c = model.scores(texts, model.automaton())
    assert a >= 0.7 and b >= 0.7 and c < 0.3
