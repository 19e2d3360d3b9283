"""Matching blocks and the title score against plain versions."""

import random
import re
import time
from difflib import SequenceMatcher

from sitesift.functions.similarity import (matched, partial_distance, ratio_2mt, title_score, title_score_udf)


def strings(n, letters="ab c", most=14):
    rng = random.Random(12)
    return ["".join(rng.choices(letters, k=rng.randrange(most))) for _ in range(n)]


def test_matching_blocks_against_the_plain_matcher():
    xs = strings(3000)
    for a, b in zip(xs, xs[1:]):
        assert matched(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    for a, b in zip(xs[::50], strings(60, "abé\U0001f600", 200)):
        assert ratio_2mt(a, b) == int(round(100 * SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio()))
    assert ratio_2mt("", "") == 100 and ratio_2mt("", "x") == 0
    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh ", k=20_000))
    start = time.time()
    assert matched(a, a[5_000:] + a[:5_000]) >= 15_000
    assert time.time() - start < 20


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def nearest_substring(a, b):
    return min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


def plain_score(a, b):
    a, b = (re.sub("[^a-z0-9]", " ", s.lower()).strip() for s in (a, b))
    if not a or not b:
        return 0
    ratio = lambda x, y: 100 * (1 - distance(x, y) / max(len(x), len(y))) if x and y else 0
    part = lambda x, y: 100 * (1 - nearest_substring(*sorted((x, y), key=len)) / min(len(x), len(y))) if x and y else 0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    form, scale = (ratio, 1.0) if longer < 1.5 else (part, 0.9 if longer <= 8 else 0.6)
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    sets = [both, (both + " " + only_x).strip(), (both + " " + only_y).strip()]
    forms = [form(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), form(sets[0], sets[1]), form(sets[0], sets[2]), form(sets[1], sets[2])]
    return int(max(ratio(a, b), scale * form(a, b), 0.95 * scale * max(forms)) + 0.5)


def test_title_score_against_a_plain_version(spark):
    xs = strings(160, "abc  1-É", 18) + ["sales manager", "Manager, Sales", "head of sales and marketing department north", "ceo", "", "x" * 40, "  "]
    pairs = list(zip(xs, xs[1:])) + list(zip(xs, xs[7:]))
    for a, b in pairs:
        short, long = sorted((a, b), key=len)
        assert partial_distance(short, long) == (nearest_substring(short, long) if short else 0)
        assert title_score(a, b) == plain_score(a, b) == title_score(b, a)
    df = spark.createDataFrame([*pairs, (None, "x"), ("x", None)], "a string, b string")
    got = [r[0] for r in df.select(title_score_udf("a", "b")).collect()]
    assert got == [plain_score(a, b) for a, b in pairs] + [None, None]
    assert title_score("Sales Manager", "manager sales") == 95 and title_score("CEO", "the ceo of a firm that sells things") == 60
