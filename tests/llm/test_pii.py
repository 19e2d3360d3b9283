import hashlib
import random
import re

import numpy as np

from sitesift.llm import pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and not (12 <= len(d) <= 19 and luhn(d))
                    or k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20000):
        letters = rng.choice(["aé1.@- ", "0123456789 -", "+0123 ().-", "12.0@a+-", " 4.1+"])
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_stay_linear():
    for t in ["1" * 300_000, "a." * 100_000 + "@", "+1" + "(" * 200_000, "@" * 50_000, "1." * 100_000]:
        pii._row(t)


def test_expectation_maximisation_finds_reliable_labelers():
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.3
    counts = {}
    for y in truth:
        votes = tuple(int((1 if y else -1) * (1 if rng.random() < a else -1)) if rng.random() < 0.8 else 0
                      for a in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    share, p, post = pii.reliabilities(counts)
    assert abs(share - 0.3) < 0.05
    right = [p[k, 1, 2] / (p[k, 1, 2] + p[k, 1, 0]) for k in range(3)]
    assert right[0] > 0.9 and 0.8 < right[1] < 0.97 and right[2] < 0.75
    assert post[(1, 1, 1)] > 0.95 > 0.05 > post[(-1, -1, -1)]


def _table(found):
    return {r["id"]: r for r in pii.span_table(found).collect()}


def test_spans_of_documents(spark):
    docs = [(1, None), (2, ""), (3, "Write to a.b@c.example.org, call +1 (212) 555-0101"), (4, "10.0.0.1 and 300.1.1.1"),
            (5, "card 4111 1111 1111 1111 or 9807915762804490"), (6, "ask Dr. Ana Ruiz\nab 1234567890123456 cd"),
            (6, "ask Dr. Ana Ruiz\nab 1234567890123456 cd"), (7, "version 3.0 of 2024")]
    got = _table(pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")))
    for i, t in docs:
        base = plain(t or "")
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for _, k, _ in base) for n in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    assert got[7]["spans"] == "" and "name:" in got[6]["spans"] and "number:" in got[5]["spans"]


def test_redact_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "mail x@y.org now", 16, "a"), (2, None, None, "b"), (3, "plain", 5, None)],
                                 "doc_id long, text string, n_chars long, more string")
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["text"] == "mail [EMAIL] now" and got[1]["n_chars"] == 16 and got[2]["text"] is None
    assert got[3]["text"] == "plain" and pii.redact(docs).columns == docs.columns
    assert pii.masked("ab 1.2.3.4x", [(3, 1, 10), (3, 6, 10)]) == "ab [IP]x"
