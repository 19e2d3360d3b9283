"""Secret scans: a linear-chain conditional random field tags tokens as secret begin,
inside or outside.

Base patterns (assignments, access keys, long hexadecimal runs) always give spans. Their
values label the tokens of a bounded sample of distinct texts, some of which are copied
with the values spelled in other alphabets and under other names; the field learns what a
secret looks like (shape), what stands around it (neighbouring words) and in what kind of
text (file features), and adds what the patterns don't match. Decoding is exact
Viterbi over all tokens of every whole text, in numpy: chunks of 64 tokens are decoded for
each label before them, then the chunks of a text are chained.

Texts are read as one byte per code point ("?" beyond ASCII), so offsets are code points.
A text is held whole by its task, with some 30 bytes a character.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import stored

KINDS = ["assign", "access", "hex", "secret"]        # the first three are base kinds
BASE = 3
FIT_TEXTS = 200            # distinct texts with a base span fitted at most, and twice as many without
CHUNK = 64                 # tokens decoded side by side
PART_BYTES = 1 << 21       # texts joined for one pass, unless a single one is longer

_STEMS = (b"passw", b"secret", b"token", b"api")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_BLANK, _LOWER, _UPPER, _DIGIT, _JOIN, _EQUALS, _COLON, _QUOTE, _OTHER, _FOREIGN = range(10)


def _classes() -> np.ndarray:
    t = np.full(256, _OTHER, np.uint8)
    t[:33], t[127] = _BLANK, _BLANK
    t[ord("a"):ord("z") + 1], t[ord("A"):ord("Z") + 1], t[ord("0"):ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    for chars, c in (("+/_-.", _JOIN), ("=", _EQUALS), (":", _COLON), ("\"'`", _QUOTE), ("?", _FOREIGN)):
        t[[ord(x) for x in chars]] = c
    return t


CLASS = _classes()
_IN_RUN = np.isin(np.arange(10), [_LOWER, _UPPER, _DIGIT, _JOIN, _FOREIGN])
_HEX_LOW = np.isin(np.arange(256), list(b"0123456789abcdef"))
_HEX_UP = np.isin(np.arange(256), list(b"0123456789ABCDEF"))
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32


def plain(text: str | None) -> bytes:
    """One byte per code point."""
    return (text or "").encode("ascii", "replace")


def base_spans(buf: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base kinds in joined texts."""
    out, last = [], 0
    low = buf.lower()
    for at in sorted(m for stem in _STEMS for m in _places(low, stem)):
        m = _ASSIGN.match(buf, at) if at >= last else None
        if m:
            last = m.end()
            if last - m.start(2) >= 6:
                out.append((at, 0, last, m.start(2)))
    for m in _ACCESS.finditer(buf):
        if m.end() - m.start() >= 20:
            out.append((m.start(), 1, m.end(), m.start()))
    hexes = np.concatenate([[False], _HEX_LOW[np.frombuffer(buf, np.uint8)], [False]])
    edges = np.flatnonzero(hexes[1:] != hexes[:-1])
    for s, e in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= 24].tolist():
        out.append((s, 2, e, s))
    return sorted(out)


def _places(buf: bytes, stem: bytes):
    at = buf.find(stem)
    while at >= 0:
        yield at
        at = buf.find(stem, at + 1)


# ---- tokens and their features ---------------------------------------------------------
_LENGTHS = np.searchsorted([4, 8, 12, 16, 20, 24, 32, 40, 64], np.arange(66), side="right")
BUCKETS = 256
SIZES = [48, 480, 16, 40, BUCKETS, BUCKETS, BUCKETS, 2 * BUCKETS, 32, BUCKETS, 2]


def tokens(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends: runs of letters, digits and joiners; other signs by themselves."""
    cls = CLASS[a]
    run = np.concatenate([[False], _IN_RUN[cls], [False]])
    first, last = run[1:-1] & ~run[:-2], run[1:-1] & ~run[2:]
    sign = ~run[1:-1] & (cls != _BLANK)
    return np.flatnonzero(first | sign), np.flatnonzero(last | sign) + 1


def _shift(x: np.ndarray, doc: np.ndarray, by: int) -> np.ndarray:
    """Value of the token ``by`` places before (after, if negative) in the same text, or 0."""
    out = np.zeros_like(x)
    if by > 0 and len(x) > by:
        out[by:] = np.where(doc[by:] == doc[:-by], x[:-by], 0)
    elif by < 0 and len(x) > -by:
        out[:by] = np.where(doc[:by] == doc[-by:], x[-by:], 0)
    return out


def features(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """One categorical value a token for each entry of SIZES. ``doc`` numbers the texts."""
    n = len(starts)
    if not n:
        return [np.zeros(0, np.int32) for _ in SIZES]
    cls, edges = CLASS[a], np.stack([starts, ends], 1).ravel()

    def total(flags):
        return np.add.reduceat(np.append(flags, False).view(np.uint8), edges, dtype=np.int32)[::2]

    size = (ends - starts).astype(np.int32)
    lower, upper, digit, join = (total(cls == c) for c in (_LOWER, _UPPER, _DIGIT, _JOIN))
    foreign = total(cls == _FOREIGN)
    head = cls[starts]
    changes = np.concatenate([[False], cls[1:] != cls[:-1]])
    changes[starts] = False
    turns = total(changes)
    run = _IN_RUN[head]
    capital = (upper == 1) & (head == _UPPER)
    mix = ((lower + foreign > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (join > 0) + 16 * capital).astype(np.int32)
    comp = np.where(run, mix, 32 + head).astype(np.int32)
    length = _LENGTHS[np.minimum(size, 65)].astype(np.int32)
    shape = np.minimum(8 * turns // np.maximum(size, 1), 7) + 8 * (size >= 16)
    hexes = (total(_HEX_LOW[a]) == size) + 2 * (total(_HEX_UP[a]) == size)
    # identity of short tokens without digits; others share a bucket
    h = np.zeros(n, np.uint64)
    for k in range(16):
        at = starts + k
        h = h * np.uint64(0x100000001B3) + np.where(at < ends, LOW[a[np.minimum(at, len(a) - 1)]], 0).astype(np.uint64)
    word = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (BUCKETS - 2) + 2
    word = np.where((digit > 0) | (size > 20), 1, word).astype(np.int32)
    index = np.arange(n)
    is_word = run & (digit == 0) & (size <= 20) & (lower + upper + foreign > 0)
    last_word = np.concatenate([[-1], np.maximum.accumulate(np.where(is_word, index, -1))[:-1]])
    last_sign = np.concatenate([[-1], np.maximum.accumulate(np.where((head == _EQUALS) | (head == _COLON), index, -1))[:-1]])
    near = (last_word >= 0) & (index - last_word <= 5)
    near &= doc[np.maximum(last_word, 0)] == doc
    owner = np.where(near, word[np.maximum(last_word, 0)], 0) * 2 + (near & (last_sign > last_word))
    # the file: how much of it is signs and digits, whether it assigns
    docs = int(doc[-1]) + 1
    count = np.maximum(np.bincount(doc, minlength=docs), 1)
    signs = np.minimum(8 * np.bincount(doc, ~run, docs) / count, 3).astype(np.int32)
    digits = np.minimum(8 * np.bincount(doc, digit > 0, docs) / count, 1).astype(np.int32)
    assigns = (np.bincount(doc, head == _EQUALS, docs) > 0).astype(np.int32)
    kind = ((signs * 2 + digits) * 2 + assigns)[doc] * 2 + (digit > 0)
    before = np.concatenate([[0], ends[:-1]])
    breaks = np.concatenate([[0], np.cumsum(a == 10)])
    opens = (breaks[starts] > breaks[before]) | (starts == 0)
    return [x.astype(np.int32) for x in (
        comp, length * 48 + comp, shape, hexes * 10 + length, _shift(word, doc, 1), _shift(word, doc, 2), _shift(word, doc, -1),
        owner, kind, word, opens)]


def token_labels(starts: np.ndarray, ends: np.ndarray, values: list[tuple[int, int]]) -> np.ndarray:
    """0 outside, 1 begin, 2 inside: tokens that touch a base span's value."""
    y = np.zeros(len(starts), np.int8)
    last = -1
    for s, e in sorted(values):
        lo, hi = max(np.searchsorted(ends, s, "right"), last), np.searchsorted(starts, e, "left")
        if lo < hi:
            y[lo], y[lo + 1:hi] = 1, 2
            last = hi
    return y


# ---- the field -------------------------------------------------------------------------
_OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
BARRED = -8.0              # weight of inside after outside


class SecretCrf:
    """W (all feature values, 2) weighs begin and inside against outside; T (3, 3) the
    steps. Before and after every text stands an outside."""

    def __init__(self, W: np.ndarray | None = None, T: np.ndarray | None = None):
        self.W = np.zeros((_OFFSETS[-1], 2)) if W is None else W
        self.T = np.zeros((3, 3)) if T is None else T
        if W is None:
            self.W[:SIZES[0]] = -4.0                 # without examples every token is outside

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        e = np.zeros((len(feats[0]), 3))
        for f, lo in zip(feats, _OFFSETS):
            e[:, 1:] += self.W[f + lo]
        return e

    def fit(self, pieces: list[tuple[np.ndarray, np.ndarray]], rounds: int = 40, rate: float = 0.3, shrink: float = 0.01):
        """Adam on the log-likelihood of pieces (features (n, len(SIZES)), labels (n,)), each
        taken to stand between outsides."""
        pieces = [(f, y) for f, y in pieces if len(y)]
        if not any((y > 0).any() for _, y in pieces):
            return self
        rows, size = len(pieces), max(len(y) for _, y in pieces)
        flat = np.concatenate([f for f, _ in pieces]) + _OFFSETS[:-1]
        at = np.concatenate([k * size + np.arange(len(y)) for k, (_, y) in enumerate(pieces)])
        y = np.concatenate([y for _, y in pieces]).astype(int)
        mask = np.zeros(rows * size, bool)
        mask[at] = True
        mask = mask.reshape(rows, size)
        Y = np.zeros(rows * size, int)
        Y[at] = y
        Y = Y.reshape(rows, size)
        padded = np.concatenate([np.zeros((rows, 1), int), Y, np.zeros((rows, 1), int)], 1)
        steps_live = np.concatenate([np.ones((rows, 1), bool), mask], 1)      # step t leads from a token that exists
        seen = np.zeros((3, 3))
        np.add.at(seen, (padded[:, :-1][steps_live], padded[:, 1:][steps_live]), 1)
        theta = np.concatenate([np.zeros(self.W.size), np.zeros(9)])
        theta[:SIZES[0] * 2] = -2.0
        m = v = np.zeros_like(theta)
        for k in range(1, rounds + 1):
            self.W, self.T = theta[:-9].reshape(self.W.shape), theta[-9:].reshape(3, 3).copy()
            self.T[0, 2] = BARRED
            e = np.zeros((rows * size, 3))
            e[at, 1:] = self.W[flat].sum(axis=1)
            p, expected = self._expect(e.reshape(rows, size, 3), mask)
            gap = np.stack([(y == c) - p.reshape(-1, 3)[at, c] for c in (1, 2)], 1)
            gw = np.stack([sum(np.bincount(flat[:, f], gap[:, c], len(self.W)) for f in range(flat.shape[1])) for c in (0, 1)], 1)
            g = np.concatenate([gw.ravel(), (seen - expected).ravel()]) - shrink * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
        self.W, self.T = theta[:-9].reshape(self.W.shape), theta[-9:].reshape(3, 3).copy()
        self.T[0, 2] = BARRED
        return self

    def _expect(self, e: np.ndarray, mask: np.ndarray):
        """Forward-backward, scaled at every step: label marginals of each token and the
        expected counts of the steps."""
        rows, size, _ = e.shape
        step, near = np.exp(self.T), np.exp(e - e.max(axis=2, keepdims=True))
        fwd, bwd, scale = np.zeros_like(e), np.zeros_like(e), np.ones((rows, size))
        for t in range(size):
            a = (fwd[:, t - 1] @ step if t else np.tile(step[0], (rows, 1))) * near[:, t]
            scale[:, t] = a.sum(axis=1)
            fwd[:, t] = a / scale[:, t, None]
            if t:
                gone = ~mask[:, t]
                fwd[gone, t], scale[gone, t] = fwd[gone, t - 1], 1.0
        total = fwd[:, -1] @ step[:, 0]                     # the step to the outside behind
        bwd[:, -1] = step[:, 0] / total[:, None]
        for t in range(size - 2, -1, -1):
            ahead = (near[:, t + 1] * bwd[:, t + 1] / scale[:, t + 1, None]) @ step.T
            bwd[:, t] = np.where(mask[:, t + 1, None], ahead, bwd[:, t + 1])
        p = fwd * bwd * mask[:, :, None]
        expected = np.zeros((3, 3))
        expected[0] += p[:, 0].sum(axis=0)
        expected[:, 0] += p[np.arange(rows), mask.sum(axis=1) - 1].sum(axis=0)
        late = near[:, 1:] * bwd[:, 1:] / scale[:, 1:, None] * mask[:, 1:, None]
        return p, expected + np.einsum("rti,rtj->ij", fwd[:, :-1], late) * step

    def viterbi(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Best label of every token of several texts, one after the other; ties go to the
        smaller label number."""
        n = len(e)
        if not n:
            return np.zeros(0, np.int8)
        count = np.bincount(doc)
        chunks = -(-count // CHUNK)
        first = np.concatenate([[0], np.cumsum(chunks)])
        begin = np.concatenate([[0], np.cumsum(count)])
        place = (first[doc] * CHUNK + np.arange(n) - begin[doc])
        grid = np.zeros((int(first[-1]) * CHUNK, 3))
        grid[:, 1:] = -1e9                                # places without a token are outside
        grid[place] = e
        grid = grid.reshape(-1, CHUNK, 3)
        # best scores (chunk, label before, label now) and where they came from
        back = np.zeros((CHUNK, len(grid), 3, 3), np.int8)
        score = np.broadcast_to(self.T, (len(grid), 3, 3)) + grid[:, 0, None, :]
        for t in range(1, CHUNK):
            options = score[:, :, :, None] + self.T
            back[t] = options.argmax(axis=2)
            score = options.max(axis=2) + grid[:, t, None, :]
        # chain the chunks of each text
        order = np.flatnonzero(chunks)
        total, came = np.tile([0.0, -np.inf, -np.inf], (len(count), 1)), np.zeros((len(grid), 3), np.int8)
        for k in range(int(chunks.max())):
            order = order[chunks[order] > k]
            at = first[order] + k
            options = total[order][:, :, None] + score[at]
            came[at] = options.argmax(axis=1)
            total[order] = options.max(axis=1)
        label = np.zeros(len(count), np.int8)
        some = chunks > 0
        label[some] = (total[some] + self.T[:, 0]).argmax(axis=1)
        final, entry = np.zeros(len(grid), np.int8), np.zeros(len(grid), np.int8)
        order = np.flatnonzero(chunks)
        for k in range(int(chunks.max()) - 1, -1, -1):
            here = order[chunks[order] > k]
            at = first[here] + k
            final[at] = label[here]
            label[here] = came[at, label[here]]
            entry[at] = label[here]
        out = np.zeros((len(grid), CHUNK), np.int8)
        rows = np.arange(len(grid))
        for t in range(CHUNK - 1, -1, -1):
            out[:, t] = final
            final = back[t][rows, entry, final]
        return out.ravel()[place]


def _parts(texts: list[bytes]):
    """Runs of texts that are scanned together: (first, joined by line ends, their starts)."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PART_BYTES):
            size += len(texts[hi]) + 1
            hi += 1
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[lo:hi]])])[:-1]
        yield lo, b"\n".join(texts[lo:hi]), begins
        lo = hi


def _read(buf: bytes, begins: np.ndarray):
    a = np.frombuffer(buf, np.uint8)
    starts, ends = tokens(a)
    doc = np.searchsorted(begins, starts, "right") - 1
    return starts, ends, doc, features(a, starts, ends, doc)


def scan(texts: list[bytes], crf: SecretCrf) -> list[tuple[list, list]]:
    """Base spans and further spans (start, kind, end) of each text."""
    out = [([], []) for _ in texts]
    for lo, buf, begins in _parts(texts):
        found = base_spans(buf)
        taken = []
        for s, k, e, _ in found:
            d = int(np.searchsorted(begins, s, "right")) - 1
            out[lo + d][0].append((s - int(begins[d]), k, e - int(begins[d])))
            taken.append((s, e))
        starts, ends, doc, feats = _read(buf, begins)
        y = crf.viterbi(crf.scores(feats), doc)
        at = np.flatnonzero(y)
        if not len(at):
            continue
        opens = np.concatenate([[True], (np.diff(at) > 1) | (y[at[1:]] == 1) | (np.diff(doc[at]) > 0)])
        cover = np.zeros(len(buf) + 1, np.int32)
        for s, e in taken:
            cover[s] += 1
            cover[e] -= 1
        cover = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
        firsts = np.flatnonzero(opens)
        for i, j in zip(firsts.tolist(), [*firsts[1:].tolist(), len(at)]):
            s, e = int(starts[at[i]]), int(ends[at[j - 1]])
            if cover[e] == cover[s]:                     # touches no base span
                e = s + len(buf[s:e].rstrip(b"."))
                d = int(doc[at[i]])
                if e > s:
                    out[lo + d][1].append((s - int(begins[d]), BASE, e - int(begins[d])))
    return out


# names under which secrets go in files, and the alphabets they are written in (our own lists)
NAMES = [b"key", b"pwd", b"auth", b"bearer", b"credential", b"access_key", b"private_key", b"signature", b"api-key"]
_UP, _DOWN, _NUM = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
ALPHABETS = [_NUM + b"abcdef", _NUM + b"ABCDEF", _NUM + _UP, _NUM + _DOWN, _NUM + _UP + _DOWN, _NUM + _UP + _DOWN + b"+/", _NUM + _UP + _DOWN + b"-_"]
RESPELLED = 6              # copies of a text with base spans, their values in other alphabets


def respelled(text: bytes, seed: int) -> tuple[bytes, list[tuple[int, int]]]:
    """``text`` with the value of each base span written anew in some alphabet, a third of
    the assignments under another name and a third without any, so that the field learns
    more than the patterns know; and where the values are."""
    rng = np.random.default_rng(seed)
    out, values, last, size = [], [], 0, 0
    for s, k, e, v in base_spans(text):
        if s < last:
            continue
        letters = ALPHABETS[rng.integers(len(ALPHABETS))]
        value = bytes(letters[i] for i in rng.integers(len(letters), size=rng.integers(16, 49))) + b"=" * int(rng.integers(3) // 2)
        lead = text[s:v]
        way = rng.integers(3) if k == 0 else 0
        if way == 1:
            lead = NAMES[rng.integers(len(NAMES))] + lead[len(_ASSIGN.match(text, s).group(1)):]
        elif way == 2:
            lead = b""
        out += [text[last:s], lead, value]
        size += s - last + len(lead)
        values.append((size, size + len(value)))
        size, last = size + len(value), e
    return b"".join([*out, text[last:]]), values


def fit_pieces(text: bytes, values: list[tuple[int, int]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """A whole text cut after 32 tokens or more, before an outside: features and labels."""
    if not text:
        return []
    starts, ends, doc, feats = _read(text, np.zeros(1, np.int64))
    if values is None:
        values = [(v, e) for _, _, e, v in base_spans(text)]
    y = token_labels(starts, ends, values)
    f = np.stack(feats, 1).astype(np.int16)
    out, lo = [], 0
    while lo < len(y):
        hi = lo + 32
        while hi < len(y) and y[hi]:
            hi += 1
        out.append((f[lo:hi], y[lo:hi]))
        lo = hi
    return out


def examples(text: bytes, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pieces of a text and, where it has base spans, of its respelled copies."""
    out = fit_pieces(text)
    if any(y.any() for _, y in out):
        for k in range(RESPELLED):
            out += [(f, y) for f, y in fit_pieces(*respelled(text, (seed + k) % 2 ** 63)) if y.any()]
    return out


# ---- on Spark --------------------------------------------------------------------------
def _hit(text: Column) -> Column:
    """Whether a text may hold a base span (a superset, found without Python)."""
    low = F.lower(text)
    some = F.contains(text, F.lit("AKIA")) | text.rlike("[0-9a-f]{24}")
    for stem in _STEMS:
        some |= F.contains(low, F.lit(stem.decode()))
    return some


def train(docs: DataFrame, text_col: str = "text", limit: int = FIT_TEXTS) -> SecretCrf:
    """A field fitted on at most ``limit`` distinct texts that may hold a base span and
    twice as many others, the first by digest; whole texts, read in the executors. Without
    any base span the field marks nothing."""
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text).alias("key"), text.alias("text"))
    marks = rows.groupBy("key").agg(F.max(_hit(F.col("text"))).alias("hit"))
    marks = stored(marks, "secret-marks")
    chosen = [r["key"] for hit, n in ((True, limit), (False, 2 * limit))
              for r in marks.where(F.col("hit") == hit).select("key").orderBy("key").limit(n).collect()]
    if not chosen:
        return SecretCrf()

    def run(batches):
        done = set()
        for b in batches:
            for i, key in enumerate(b.column(0).to_pylist()):
                if key in done:
                    continue
                done.add(key)
                pieces = examples(plain(b.column(1)[i].as_py()), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), pa.array([[f.tobytes() for f, _ in pieces]], pa.list_(pa.binary())),
                     pa.array([[y.tobytes() for _, y in pieces]], pa.list_(pa.binary()))], names=["key", "f", "y"])

    some = rows.where(F.col("key").isin(chosen)).mapInArrow(run, "key long, f array<binary>, y array<binary>")
    found = sorted(some.dropDuplicates(["key"]).collect(), key=lambda r: r["key"])
    return SecretCrf().fit([(np.frombuffer(f, np.int16).reshape(-1, len(SIZES)).astype(np.int64), np.frombuffer(y, np.int8))
                            for r in found for f, y in zip(r["f"], r["y"])])


SPANS = "array<struct<s:int,k:int,e:int>>"
_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))


def secrets(docs: DataFrame, crf: SecretCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and more (spans as arrays of start, kind number,
    end; code points, end exclusive; an assignment's span is its whole match). Null and
    empty texts have none; equal rows get equal spans; an empty table gives no rows; other
    columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = scan([plain(t) for t in part.column(1).to_pylist()], shared.value)
                cols = [[[{"s": s, "k": k, "e": e} for s, k, e in r[i]] for r in found] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, _ARROW) for c in cols)],
                                                 names=["id", "base", "more"])

    return rows.mapInArrow(run, f"id {kind}, base {SPANS}, more {SPANS}")


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def span_table(found: DataFrame) -> DataFrame:
    """Counts of base kinds and span lists as text, from ``secrets`` rows."""
    counts = [F.expr(f"size(filter(base, x -> x.k = {k}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, crf: SecretCrf, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, touching ones together, replaced by ``mark``. Null texts
    stay null; nothing is shuffled."""
    at, schema = [c.lower() for c in docs.columns].index(text_col.lower()), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def clean(text, spans):
        if not spans:
            return text
        out, last = [], 0
        for s, _, e in sorted(spans):
            if s >= last:
                out += [text[last:s], mark]
            last = max(last, e)
        return "".join([*out, text[last:]])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = part.column(at).to_pylist()
                new = [None if t is None else clean(t, base + more)
                       for t, (base, more) in zip(texts, scan([plain(t) for t in texts], shared.value))]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)
