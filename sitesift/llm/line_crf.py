"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional
random field; the share of a document's words in content lines decides whether it stays.

The field is fitted in numpy (forward-backward) on a bounded sample of labelled
documents, whose lines take the document's label; the chain smooths over single lines.
Decoding is Viterbi over all lines of every whole text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import binary_texts

SAMPLE_DOCS = 2000      # labelled documents fitted at most
SAMPLE_LINES = 64       # of each, this many lines in a row are fitted
PIECE = 24              # words in which distinct ones are counted
REPEAT = 8              # words in a window that may repeat
MIN_WORDS, MAX_REPEAT = 20, 30
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_TAIL = bytes(range(128, 192))                     # bytes inside a code point
N_FEATURES = 13


def _count(line: bytes, some: bytes) -> int:
    return len(line) - len(line.translate(None, some))


def line_features(line: bytes, seen: bool) -> list[float]:
    """Features of one line with a word: shares and flags between 0 and 1. Distinct
    words are counted in pieces, so that long lines of prose don't look repetitive."""
    words = line.split()
    n, size = len(words), len(line)
    last = words[-1][-1:]
    distinct = sum(len(set(words[i:i + PIECE])) for i in range(0, n, PIECE)) / n
    return [1.0, min(n, 40) / 40, float(n < 4), distinct, float(distinct < 0.5),
            min(1.0, _count(line, _SYMBOLS) / n), float(2 * _count(line, _SYMBOLS) > n),
            min(1.0, 3 * _count(line, _UPPER) / size), float(2 * _count(line, _UPPER) > size),
            min(1.0, 3 * _count(line, _DIGIT) / size), float(last in (b".", b"!", b"?")),
            min(1.0, line.count(b"!!") / n), float(seen)]


def document_lines(text: bytes) -> tuple[list[list[float]], list[int]]:
    """Features and numbers of words of the lines that hold a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            rows.append(line_features(line, line in seen))
            sizes.append(n)
            seen.add(line)
    return rows, sizes


class LineCrf:
    """Two labels (0 boilerplate, 1 content): W weighs features for content against
    boilerplate, T (2, 2) the steps between lines (fitted: staying in a label)."""

    def __init__(self, W: np.ndarray | None = None, T: np.ndarray | None = None):
        self.W = np.zeros(N_FEATURES) if W is None else W
        self.T = np.zeros((2, 2)) if T is None else T

    def _marginals(self, score: np.ndarray, mask: np.ndarray):
        """Forward-backward over padded documents (B, L): P(content) of each line and
        the expected counts of the steps."""
        b, size = score.shape
        unary = np.stack([np.zeros_like(score), score], axis=2)
        fwd, bwd = np.zeros((b, size, 2)), np.zeros((b, size, 2))
        fwd[:, 0] = unary[:, 0]
        for t in range(1, size):
            step = np.logaddexp(fwd[:, t - 1, 0, None] + self.T[0], fwd[:, t - 1, 1, None] + self.T[1])
            fwd[:, t] = np.where(mask[:, t, None], step + unary[:, t], fwd[:, t - 1])
        for t in range(size - 2, -1, -1):
            ahead = unary[:, t + 1] + bwd[:, t + 1]
            step = np.logaddexp(self.T[:, 0] + ahead[:, 0, None], self.T[:, 1] + ahead[:, 1, None])
            bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])[:, None]
        p = np.exp(np.clip(fwd[:, :, 1] + bwd[:, :, 1] - total, -50, 0)) * mask
        steps = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                edge = (fwd[:, :-1, i] + self.T[i, j] + unary[:, 1:, j] + bwd[:, 1:, j] - total)
                steps[i, j] = (np.exp(np.clip(edge, -50, 0)) * mask[:, 1:]).sum()
        return p, steps

    def fit(self, docs: list[list[list[float]]], labels: list[int], rounds: int = 150, rate: float = 0.1,
            shrink: float = 1e-3):
        """Adam on the penalised mean log-likelihood; both classes weigh alike."""
        if len(set(labels)) < 2:
            return self
        size = max(map(len, docs))
        x = np.zeros((len(docs), size, N_FEATURES))
        mask = np.zeros((len(docs), size), bool)
        for k, d in enumerate(docs):
            x[k, :len(d)] = d
            mask[k, :len(d)] = True
        y = np.array(labels)
        share = Counter(labels)
        weight = np.array([len(docs) / 2 / share[v] for v in labels])[:, None] * mask
        n = weight.sum()
        m = v = np.zeros(N_FEATURES + 1)
        for k in range(1, rounds + 1):
            p, steps = self._marginals(x @ self.W, mask)
            gw = ((weight * (y[:, None] - p))[:, :, None] * x).sum(axis=(0, 1)) / n - shrink * self.W
            seen = np.zeros((2, 2))
            for c in (0, 1):
                seen[c, c] = mask[y == c, 1:].sum()
            # one weight for staying and one for changing, alike for both labels: else long
            # documents would push the labels' own bias into the steps
            gt = np.trace(seen - steps) / mask.sum() - shrink * self.T[0, 0]
            g = np.append(gw, gt)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
            self.W = self.W + step[:N_FEATURES]
            self.T = self.T + step[-1] * np.eye(2)
        return self

    def viterbi(self, rows: list[list[float]]) -> list[int]:
        """Best label of each line; a tie goes to content."""
        if not rows:
            return []
        score = (np.array(rows) @ self.W).tolist()
        (t00, t01), (t10, t11) = self.T.tolist()
        a, b, back = 0.0, score[0], []
        for s in score[1:]:
            back.append((a + t00 <= b + t10, a + t01 <= b + t11))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
        label = int(b >= a)
        out = [label]
        for from_0, from_1 in reversed(back):
            label = int(from_1 if label else from_0)
            out.append(label)
        return out[::-1]

    def content_share(self, text: bytes) -> float:
        rows, sizes = document_lines(text)
        total = sum(sizes)
        return sum(n for n, c in zip(sizes, self.viterbi(rows)) if c) / total if total else 0.0


def repeated_words(words: list[bytes], window: int = REPEAT) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):                       # equal windows have equal hashes
        h = h * np.uint64(0x9E3779B97F4A7C15) + seq[k:k + n] + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    key = [tuple(seq[i:i + window].tolist()) for i in at.tolist()]      # the words decide, not the hash
    count = Counter(key)
    cover = np.zeros(len(words) + 1, np.int64)
    for i, k in zip(at.tolist(), key):
        if count[k] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    chars = len(text.translate(None, _SPACE + _TAIL))
    lines = Counter(line for line in text.split(b"\n") if line.split())
    return (len(words), chars, _count(text, _SYMBOLS), sum(lines.values()) - len(lines), repeated_words(words))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int):
    """(text, label) of at most ``limit`` labelled documents in the order of a hash of
    the id. Rows with a null id or label are not used; an id labelled twice keeps its
    smaller label, an id with several texts the smallest."""
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y")))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # the middle lines of a text are fitted, not all of a very long one
    part = F.split("text", "\n")
    start = F.greatest(F.lit(1), (F.size(part) / 2 - SAMPLE_LINES / 2).cast("int"))
    lines = F.array_join(F.transform(F.slice(part, start, F.lit(SAMPLE_LINES)),
                                     lambda s: F.substring(s, 1, 4096)), "\n")
    found = rows.join(F.broadcast(chosen), "id").select("id", lines.alias("t"), "y").groupBy("id", "y").agg(F.min("t").alias("t"))
    return sorted((r["t"], r["y"]) for r in found.collect())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", limit: int = SAMPLE_DOCS) -> LineCrf:
    """A field fitted on labelled documents; without both labels, one that calls every
    line content."""
    rows = [(document_lines(t.encode())[0], y) for t, y in sample(docs, labels, id_col, text_col, label_col, limit)]
    rows = [(r, y) for r, y in rows if r]
    return LineCrf().fit([r for r, _ in rows], [y for _, y in rows])


def judge(docs: DataFrame, crf: LineCrf, id_col: str = "doc_id", text_col: str = "text",
          least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, the five measures, base_failed, content_share and
    kept. Null and empty texts have no words and fail; equal rows get equal results; an
    empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = binary_texts(part)
                cols = list(zip(*map(measures, texts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in cols),
                     pa.array([shared.value.content_share(t) for t in texts], pa.float64())],
                    names=["id", *names, "content_share"])

    out = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names) + ", content_share double")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    return out.select("id", *names, failed.alias("base_failed"),
                      (~failed & (F.col("content_share") >= least)).alias("kept"), "content_share")
