"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text is read as UTF-8 bytes in windows of ``WINDOW`` positions; both directions run
over each window from a zero state, every position gets class probabilities, and the
document's are their mean over all positions of the whole text. Training is
backpropagation through time on windows of a bounded sample of labelled documents.

Gates are hard sigmoids and the candidate a hard tangent, which numpy evaluates as
clips. Both directions share one array, (direction, hidden, lane), so a step costs a
few calls for thousands of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesift.llm.common import fold

WINDOW = 64          # positions in a window
HIDDEN = 8           # state size of each direction
LANES = 2048         # windows computed at once
PAD = 256            # symbol behind the end of a text; its positions are not pooled
SAMPLE_DOCS = 800    # labelled documents fitted at most
FIT_WINDOWS = 12288  # windows fitted at most
LEAST_ROWS = 8          # rows of a language in the sample at least
SAMPLE_CHARS = 4096  # of each, this many characters from its middle are fitted
EPOCHS = 4
_LETTER = regex.compile(r"\p{L}")


def windows(text: bytes) -> np.ndarray:
    """All bytes of a text as rows of WINDOW symbols, the last one padded."""
    n = -(-len(text) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class BiGru:
    """Parameters: E (2, symbols, 3H) input sums, U (2, 3H, H), V (classes, 2H), c."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.classes = classes
        self.E = rng.normal(0, 0.5, (2, 257, 3 * h)).astype(np.float32)
        self.U = rng.normal(0, 0.5 / np.sqrt(h), (2, 3 * h, h)).astype(np.float32)
        self.V = rng.normal(0, 0.3, (len(classes), 2 * h)).astype(np.float32)
        self.c = np.zeros(len(classes), np.float32)

    def states(self, x: np.ndarray, keep: bool = False):
        """States of windows x (lanes, T): (T, 2, H, lanes) in text order of each
        direction's own reading; with ``keep``, what backpropagation needs too."""
        lanes, steps, h = len(x), x.shape[1], HIDDEN
        s = np.zeros((2, h, lanes), np.float32)
        out = np.empty((steps, 2, h, lanes), np.float32)
        tape = []
        both = np.stack([x.T, x.T[::-1]], axis=1)                      # (T, 2, lanes)
        table = np.ascontiguousarray(self.E.transpose(0, 2, 1))         # (2, 3H, symbols)
        a = np.empty((2, 3 * h, lanes), np.float32)
        for t in range(steps):
            for d in (0, 1):
                np.take(table[d], both[t, d], axis=1, out=a[d], mode="clip")
            g = np.matmul(self.U[:, :2 * h], s)
            g += a[:, :2 * h]
            g *= 0.25
            g += 0.5
            np.clip(g, 0, 1, out=g)                                     # update and reset gates
            z, r = g[:, :h], g[:, h:]
            q = np.matmul(self.U[:, 2 * h:], r * s)
            q += a[:, 2 * h:]
            np.clip(q, -1, 1, out=q)
            if keep:
                tape.append((s, g, q))
            s = s + z * (q - s)
            out[t] = s
        return (out, both, tape) if keep else out

    def scores(self, out: np.ndarray) -> np.ndarray:
        """Class scores (T, classes, lanes): each position sees both directions."""
        h = HIDDEN
        return (np.matmul(self.V[:, :h], out[:, 0]) + np.matmul(self.V[:, h:], out[::-1, 1])
                + self.c[:, None])

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Sums over the real positions of each window of the class probabilities."""
        p = self.scores(self.states(x))
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (x.T != PAD)[:, None] / p.sum(axis=1, keepdims=True)
        return p.sum(axis=0).T

    def gradient(self, x: np.ndarray, y: np.ndarray):
        """Mean cross entropy of all positions and its gradients, back through time."""
        h, steps = HIDDEN, x.shape[1]
        out, both, tape = self.states(x, keep=True)
        p = self.scores(out)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        real = (x.T != PAD).astype(np.float32)
        total = max(1.0, float(real.sum()))
        lane = np.arange(len(x))
        loss = -float((np.log(p[:, y, lane] + 1e-9) * real).sum()) / total
        p[:, y, lane] -= 1
        p *= real[:, None] / total                                        # d loss / d scores
        back = out[::-1, 1]
        dV = np.concatenate([np.einsum("tcl,thl->ch", p, out[:, 0], optimize=True),
                             np.einsum("tcl,thl->ch", p, back, optimize=True)], axis=1)
        dc = p.sum(axis=(0, 2))
        dout = np.empty_like(out)
        dout[:, 0] = np.matmul(self.V[:, :h].T, p)
        dout[:, 1] = np.matmul(self.V[:, h:].T, p)[::-1]
        dE, dU = np.zeros_like(self.E), np.zeros_like(self.U)
        ds = np.zeros_like(out[0])
        for t in range(steps - 1, -1, -1):
            s, g, q = tape[t]
            z, r = g[:, :h], g[:, h:]
            ds = ds + dout[t]
            dq = ds * z * (np.abs(q) < 1)
            drs = np.matmul(self.U[:, 2 * h:].transpose(0, 2, 1), dq)
            dg = np.concatenate([ds * (q - s), drs * s], axis=1) * ((g > 0) & (g < 1)) * 0.25
            da = np.concatenate([dg, dq], axis=1)                         # (2, 3H, lanes)
            dU[:, :2 * h] += np.matmul(dg, s.transpose(0, 2, 1))
            dU[:, 2 * h:] += np.matmul(dq, (r * s).transpose(0, 2, 1))
            for d in (0, 1):
                order = np.argsort(both[t, d], kind="stable")
                sym = both[t, d][order]
                cut = np.flatnonzero(np.diff(sym, prepend=-1))
                dE[d, sym[cut]] += np.add.reduceat(da[d].T[order], cut, axis=0)
            ds = ds * (1 - z) + drs * r + np.matmul(self.U[:, :2 * h].transpose(0, 2, 1), dg)
        return loss, {"E": dE, "U": dU, "V": dV, "c": dc}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.02,
            seed: int = 11):
        """Adam on shuffled mini-batches, the rate falling to a tenth."""
        rng = np.random.default_rng(seed)
        m = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in "EUVc"}
        step, last = 0, epochs * max(1, -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo:lo + batch]
                _, grads = self.gradient(x[at], y[at])
                step += 1
                pace = rate * (1 - 0.9 * step / last)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w = getattr(self, k)
                    w -= pace * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-6)
        return self

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class number and mean probability for each text (uniform for no bytes)."""
        sums = np.zeros((len(texts), len(self.classes)))
        held, owner, size = [], [], 0

        def run():
            x = np.concatenate(held)
            own = np.concatenate(owner)
            for lo in range(0, len(x), LANES):
                part = self.pooled(x[lo:lo + LANES])
                for k in range(part.shape[1]):
                    sums[:, k] += np.bincount(own[lo:lo + LANES], part[:, k], len(texts))

        for i, t in enumerate(texts):
            w = windows(t)
            held.append(w)
            owner.append(np.full(len(w), i))
            size += len(w)
            if size >= 8 * LANES:
                run()
                held, owner, size = [], [], 0
        if size:
            run()
        n = sums.sum(axis=1, keepdims=True)
        p = np.where(n > 0, sums / np.maximum(n, 1e-9), 1 / max(1, len(self.classes)))
        return p.argmax(axis=1), p.max(axis=1)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_fold: int, limit: int) -> list[tuple]:
    """Labelled rows outside the held-out fold, some of every language: of each the ids that
    come first by a hash, ``limit`` shared out evenly (LEAST_ROWS for each language at least,
    however many there are), one row for each id. So no labelled language is missing, and the
    sample does not depend on partitions or on how often a row is repeated."""
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang"))
            .where((fold("id") != held_fold) & F.col("lang").isNotNull() & (F.length("text") > 0)))
    ids = rows.groupBy("lang", "id").agg(F.xxhash64("id").alias("h"))
    each = max(LEAST_ROWS, limit // max(1, rows.select("lang").distinct().count()))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = ids.withColumn("n", first).where(F.col("n") <= each).select("lang", "id")
    middle = F.greatest(F.lit(1), (F.length("text") / 2 - SAMPLE_CHARS / 2).cast("int"))
    part = rows.join(F.broadcast(chosen), ["lang", "id"]).select("lang", "id", F.substring("text", middle, F.lit(SAMPLE_CHARS)).alias("t"))
    return sorted((r["lang"], r["t"]) for r in part.groupBy("lang", "id").agg(F.min("t").alias("t")).collect())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          held_fold: int = 1, limit: int = SAMPLE_DOCS, epochs: int = EPOCHS) -> BiGru:
    """A network fitted on a sample; with no labelled row, one without classes."""
    rows = sample(docs, id_col, text_col, lang_col, held_fold, limit)
    classes = sorted({lang for lang, _ in rows})
    net = BiGru(classes)
    if rows:
        number = {c: k for k, c in enumerate(classes)}
        x = [windows(t.encode()) for _, t in rows]
        y = np.repeat([number[lang] for lang, _ in rows], [len(w) for w in x])
        x = np.concatenate(x)
        keep = np.random.default_rng(5).permutation(len(x))[:FIT_WINDOWS]
        net.fit(x[keep], y[keep], epochs=epochs)
    return net


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def _judge(net: BiGru, column) -> tuple[list[str], np.ndarray]:
    texts = [t or "" for t in column.to_pylist()]
    if not net.classes:
        return ["und"] * len(texts), np.zeros(len(texts))
    k, p = net.predict([t.encode() for t in texts])
    named = [has_letter(t) for t in texts]
    return [net.classes[i] if ok else "und" for i, ok in zip(k, named)], np.where(named, p, 0.0)


def predict(docs: DataFrame, net: BiGru, id_col: str = "doc_id", text_col: str = "text",
            held_fold: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score (mean probability of
    the language over all positions). Texts that are null or have no letter are ``und``
    with score 0, as is everything for a network without classes. A null id is not held
    out; equal rows get equal results; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)      # some 50 KB

    def run(batches):
        for b in batches:
            lang, score = _judge(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["id", "lang_pred", "score"])

    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.select("id", F.coalesce(fold("id") == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, net: BiGru, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` whose language is found with a score of at least ``least``; rows and
    columns pass through one Arrow stage unchanged."""
    schema, shared = docs.schema, docs.sparkSession.sparkContext.broadcast(net)
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        for b in batches:
            lang, score = _judge(shared.value, b.column(at).cast("string"))
            yield b.filter(pa.array([x != "und" and p >= least for x, p in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, schema)
