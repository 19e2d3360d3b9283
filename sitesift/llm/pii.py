"""Personal data: weak supervision over candidate spans.

Base patterns (e-mail, IP address, card number, phone number) always give spans. Wider
patterns give further candidates. Regex, gazetteer and context labelers vote on each
one; expectation-maximisation over the counts of vote patterns of the whole corpus
estimates how reliable each labeler is; the posteriors train a logistic span classifier
on span features, and its verdict adds spans. Texts are read once: base spans and
candidates are kept in a table of their own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import stored, strings

KINDS = ["email", "ip", "card", "phone", "handle", "name", "number"]     # the first four are base kinds
BASE = 4
FAR = 100            # characters within which another span speaks for a candidate

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9][0-9. -]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HANDLE = re.compile(r"@[A-Za-z0-9-]+")
_NAME = re.compile(r"\.? [A-ZÀ-ÖØ-Þ][^\W\d_]{2,20}(?: [A-ZÀ-ÖØ-Þ][^\W\d_]{2,20})?")

# gazetteers (our own short lists)
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor", "Señora"]
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
FIRST_NAMES = frozenset("Ana Anna Carlos David Elena Emma Hans James Jean John José Julia Karl Laura Lena Luis "
                        "Maria Marie Mary Michael Omar Paul Peter Pierre Robert Sara Sarah Sofia Thomas".split())
SPEAKS_FOR = frozenset("account call card carte contact iban konto mail mobile nummer phone ssn tarjeta tel "
                       "telefon telefono telephone teléfono téléphone".split())
SPEAKS_AGAINST = frozenset("build chapter isbn issue page release section seite section serial version vol year".split())


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their @ signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    for run in _DIGITS.finditer(text):
        lo, hi = run.span()
        if hi - lo >= 7:
            for m in _IP.finditer(text, lo, hi):
                parts = [p.lstrip("0") for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    out.append((m.start(), 1, m.end()))
        if hi - lo >= 12:
            for m in _CARD.finditer(text, lo, hi):
                if m.end() - m.start() <= 37:
                    digits = re.sub("[ -]", "", m.group())
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        out.append((m.start(), 2, m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((at, 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


def _candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of wider patterns that touch no span of ``taken``."""
    found = []
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() >= 7:
            for m in _CARD.finditer(text, *run.span()):
                s, e = m.span()
                if e - s <= 40 and sum(c.isdigit() for c in m.group()) >= 7 and not (
                        s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum()):
                    found.append((s, 6, e))
    at = text.find("@")
    while at >= 0:
        m, s = _HANDLE.match(text, at), at
        while s > 0 and text[s - 1] in _LOCAL and at - s < 64:
            s -= 1
        if m:
            found.append((s, 4, m.end()))
        at = text.find("@", m.end() if m else at + 1)
    for title in TITLES:
        at = text.find(title)
        while at >= 0:
            m = None if at and text[at - 1].isalnum() else _NAME.match(text, at + len(title))
            if m:
                found.append((at, 5, m.end()))
            at = text.find(title, at + 1)
    out, k, last = [], 0, 0
    taken = sorted(taken)
    for s, kind, e in sorted(found):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= last and not (k < len(taken) and taken[k][0] < e):
            out.append((s, kind, e))
            last = e
    return out


#: What each labeler says: 1 personal data, -1 not, 0 nothing.
def _votes(text: str, s: int, kind: int, e: int, near: bool, before: str) -> tuple[int, ...]:
    body = text[s:e]
    digits = re.sub(r"\D", "", body) if kind == 6 else ""
    if kind == 6:
        shape = 1 if 13 <= len(digits) <= 19 or (len(digits) <= 12 and len(body) > len(digits)) else -1
        gazetteer = 1 if len(digits) >= 13 and digits.startswith(ISSUERS) else 0
        checksum = -1 if len(set(digits)) <= 2 or digits in "01234567890123456789" else (
            1 if _luhn(digits) else 0)
    elif kind == 4:
        shape, gazetteer, checksum = (1 if body[0] != "@" else -1), 0, 0
    else:
        shape, checksum = (1 if body.count(" ") == 2 else 0), 0
        gazetteer = 1 if FIRST_NAMES & set(body.split()) else 0
    context = 1 if before in SPEAKS_FOR else -1 if before in SPEAKS_AGAINST else 0
    edge = text[s - 1:s] + text[e:e + 1]
    decimal = -1 if re.search(r"[.,/=#$€%]", edge[:1]) or re.match(r"[%€$/=]", edge[-1:] or " ") else 0
    return shape, gazetteer, checksum, context, decimal, (1 if near else 0)


LABELERS = 6


def _features(text: str, s: int, kind: int, e: int, near: bool, before: str) -> tuple[int, ...]:
    body = text[s:e]
    digits = sum(c.isdigit() for c in body)
    return (kind, min(digits, 24), min(body.count(" ") + body.count("-"), 3), int(near),
            int(before in SPEAKS_FOR), int(before in SPEAKS_AGAINST), int(text[s - 1:s] == "\n" or s == 0))


def _row(text: str):
    base = base_spans(text)
    more = _candidates(text, [(s, e) for s, _, e in base])
    if not more:
        return base, []
    starts = np.array([s for s, _, _ in base] + [s for s, _, _ in more])
    starts.sort()
    out = []
    for s, kind, e in more:
        lo, hi = np.searchsorted(starts, [s - FAR, e + FAR])
        near = bool(hi - lo > 1)
        word = re.search(r"([^\W\d_]+)\W{0,3}$", text[max(0, s - 24):s])
        before = word.group(1).lower() if word else ""
        out.append((s, kind, e, _votes(text, s, kind, e, near, before), _features(text, s, kind, e, near, before)))
    return base, out


SPANS = "array<struct<s:int,k:int,e:int>>"
EXTRA = "array<struct<s:int,k:int,e:int,votes:string,features:string>>"
_ARROW_BASE = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
_ARROW_EXTRA = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()),
                                   ("votes", pa.string()), ("features", pa.string())]))
PART = 256           # texts held as Python strings at once


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base spans and further candidates with the votes
    and features of each. Null counts as the empty text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                part = b.slice(lo, PART)
                found = [_row(t) for t in strings(part)]
                base = [[{"s": s, "k": k, "e": e} for s, k, e in x] for x, _ in found]
                more = [[{"s": s, "k": k, "e": e, "votes": ",".join(map(str, v)), "features": ",".join(map(str, f))}
                         for s, k, e, v, f in x] for _, x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, _ARROW_BASE),
                                                  pa.array(more, _ARROW_EXTRA)], names=["id", "base", "more"])

    return rows.mapInArrow(run, f"id {kind}, base {SPANS}, more {EXTRA}")


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 100):
    """Expectation-maximisation for a two-class model with independent labelers.

    patterns: vote pattern -> count. Returns the class share, the chance of each vote
    (-1, 0, 1) by labeler and class, and the posterior of each pattern. Pseudo-counts
    of ten votes in favour of honest labelers keep the classes from trading names.
    """
    keys = sorted(patterns)
    m = len(keys[0]) if keys else LABELERS
    votes = np.array(keys, int).reshape(len(keys), m) + 1
    n = np.array([patterns[k] for k in keys], float)
    prior = np.tile(np.array([[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]]), (m, 1, 1)) * 1.25   # labeler, class, vote
    share, p = 0.5, prior / prior.sum(axis=2, keepdims=True)
    post = np.full(len(keys), 0.5)
    for _ in range(rounds):
        like = np.log(p[np.arange(m)[:, None, None], np.arange(2)[None, :, None], votes.T[:, None, :]]).sum(axis=0)
        like += np.log([[1 - share], [share]])
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -60, 60)))
        share = (float((n * post).sum()) + 5) / (n.sum() + 10)
        for v in range(3):
            hit = (votes == v).T
            p[:, 0, v] = (hit * (n * (1 - post))).sum(axis=1) + prior[:, 0, v]
            p[:, 1, v] = (hit * (n * post)).sum(axis=1) + prior[:, 1, v]
        p /= p.sum(axis=2, keepdims=True)
    return share, p, dict(zip(keys, post.tolist()))


def _expand(features: np.ndarray) -> np.ndarray:
    """One column a value of each categorical feature, besides the bias."""
    f = np.asarray(features)
    digits = np.stack([f[:, 1] < 7, (f[:, 1] >= 7) & (f[:, 1] < 12), (f[:, 1] >= 12) & (f[:, 1] < 20), f[:, 1] >= 20], 1)
    kinds = f[:, :1] == np.arange(BASE, len(KINDS))
    splits = f[:, 2:3] == np.arange(4)
    return np.concatenate([np.ones((len(f), 1)), kinds, digits, splits, f[:, 3:]], axis=1).astype(float)


def fit_classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, rate: float = 0.5,
                   shrink: float = 1e-3) -> np.ndarray:
    """Logistic weights from (features, posterior, count) rows, by gradient descent."""
    if not rows:
        return np.zeros(_expand(np.zeros((1, 7), int)).shape[1])
    x = _expand(np.array([r[0] for r in rows]))
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (n * (p - y)) + shrink * w)
    return w


def train(found: DataFrame) -> dict[str, float]:
    """Feature pattern -> probability of personal data, from all candidates.

    Only counts by pattern reach the driver: at most 3^6 vote patterns for each of
    some thousand feature patterns, whatever the size of the corpus.
    """
    rows = (found.select(F.explode("more").alias("m")).groupBy("m.votes", "m.features")
            .agg(F.count(F.lit(1)).alias("n")).collect())
    tuple_of = lambda s: tuple(map(int, s.split(",")))
    patterns: dict[tuple, float] = {}
    for r in rows:
        patterns[tuple_of(r["votes"])] = patterns.get(tuple_of(r["votes"]), 0) + r["n"]
    _, _, post = reliabilities(patterns)
    rows = sorted((tuple_of(r["features"]), post[tuple_of(r["votes"])], r["n"]) for r in rows)
    w = fit_classifier(rows)
    seen = sorted({f for f, _, _ in rows})
    p = 1 / (1 + np.exp(-_expand(np.array(seen).reshape(len(seen), 7)) @ w))
    return {",".join(map(str, f)): float(x) for f, x in zip(seen, p)}


def _digest(spans) -> str:
    """kind:start:end by start, then kind: base kinds as listed, others by name."""
    order = sorted(spans, key=lambda x: (x[0], x[1] if x[1] < BASE else BASE, KINDS[x[1]], x[2]))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in order)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, base and more (spans as arrays of start, kind
    number, end; code points, end exclusive). Null and empty texts have none; equal
    rows get equal spans; an empty table gives no rows; other columns are ignored."""
    found = stored(candidates(docs, id_col, text_col), "pii-candidates")
    likely = train(found)
    yes = F.array(*(F.lit(f) for f in sorted(f for f, p in likely.items() if p >= least))).cast("array<string>")
    more = F.transform(F.filter("more", lambda m: F.array_contains(yes, m["features"])),
                       lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))
    return found.select("id", "base", more.alias("more"))


def span_table(found: DataFrame) -> DataFrame:
    """Counts of base kinds and span lists as text, from ``personal_data`` rows."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            base = [[(x["s"], x["k"], x["e"]) for x in r] for r in b.column(1).to_pylist()]
            more = [[(x["s"], x["k"], x["e"]) for x in r] for r in b.column(2).to_pylist()]
            counts = [pa.array([sum(k == n for _, k, _ in r) for r in base], pa.int64()) for n in range(BASE)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts,
                 pa.array([hashlib.sha256(_digest(r).encode()).hexdigest() for r in base]),
                 pa.array([_digest(x + y) for x, y in zip(base, more)])],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.select("id", "base", "more").mapInArrow(
        run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, overlapping ones together, replaced by its kind."""
    out, last = [], 0
    for s, k, e in sorted(spans):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
           least: float = 0.5) -> DataFrame:
    """``docs`` with personal data replaced by [KIND] marks. The classifier is fitted on
    all of ``docs`` first; then each text is scanned again in place, without a join, so
    rows keep their columns and nothing is shuffled. A numeric ``length_col`` is set to the new
    length where the text changed. Null texts stay null."""
    found = stored(candidates(docs, id_col, text_col).select("id", "more"), "pii-candidates")
    shared = docs.sparkSession.sparkContext.broadcast(
        frozenset(f for f, p in train(found).items() if p >= least))      # feature patterns, see train
    names = [c.lower() for c in docs.columns]
    at, schema = names.index(text_col.lower()), docs.schema
    long_at = names.index(length_col.lower()) if length_col.lower() in names else None

    def clean(text):
        base, more = _row(text)
        spans = base + [(s, k, e) for s, k, e, _, f in more if ",".join(map(str, f)) in shared.value]
        return masked(text, spans) if spans else text

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                part = b.slice(lo, PART)
                old = part.column(at).to_pylist()
                new = [None if t is None else clean(t) for t in old]
                if long_at is not None and pa.types.is_integer(part.schema.field(long_at).type):
                    n = [v if o == t or t is None else len(t)
                         for v, o, t in zip(part.column(long_at).to_pylist(), old, new)]
                    part = part.set_column(long_at, part.schema.field(long_at),
                                           pa.array(n, part.schema.field(long_at).type))
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)
