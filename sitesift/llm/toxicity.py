"""Toxicity: a lexicon learned from labels, matched through Levenshtein automata.

Words that labelled toxic documents use in several contexts and others do not form a
lexicon, stored as a trie; stems shared by several such words become open entries. The
trie is intersected with the Levenshtein automata of its entries, and the product is
made deterministic as words are read, so misspelled terms cost one walk, not one
distance per entry. A digit or symbol inside a word is an edit like any other letter;
forms near an entry that the labelled rows show to be ordinary words are left out. Every match is weighed by its context window: matches between
quotation marks or behind words of reporting count apart from plain ones. A logistic
model over these counts gives the score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesift.llm.common import fold, stored, strings

SAMPLE_DOCS = 12000     # labelled documents learned from at most
MAX_TERMS = 4000        # lexicon entries at most, the best supported ones
MIN_CONTEXTS = 3        # different words before a term in toxic documents
MIN_ODDS = 2.5          # log odds of toxic against other documents
STEM, STEM_END = 4, 8    # letters of a stem
FUZZY_FROM = 4          # shortest term that may be misspelled
WINDOW = 6              # words looked at before a match
_WORD = re.compile(r"[^\W\d_]+")
#: A word, one digit or symbol and the word behind it, which may begin the next such pair.
_JOINED = re.compile(r"(?<![^\W\d_])([^\W\d_]++)([\d_]|[^\w\s])(?=([^\W\d_]++))")
_QUOTE = re.compile(r"[\"“”«»„‟]|(?<!\w)['‘]|['’](?!\w)")
#: Words that report what others say (our own short list).
REPORTING = frozenset("said says called quote quoted quotes word term slur insult sagte nannte zitat wort dit "
                      "appelle mot citation dijo dice llamó palabra cita".split())


class Automaton:
    """The lexicon trie times its Levenshtein automata (one edit), determinised lazily.

    A state is a set of (trie node, edits). Entries of FUZZY_FROM letters or more accept
    one insertion, deletion, substitution or swap of neighbours; open entries (stems)
    accept any ending once read without an edit."""

    EXACT, STEMMED, FUZZY = 1, 2, 3

    def __init__(self, terms: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]        # 0 none, 1 term, 2 stem
        self.long: list[bool] = [False]  # some entry below may be misspelled
        for kind, entries in ((1, terms), (2, stems)):
            for w in entries:
                at, path = 0, [0]
                for c in w:
                    nxt = self.child[at].get(c)
                    if nxt is None:
                        nxt = len(self.child)
                        self.child[at][c] = nxt
                        self.child.append({})
                        self.end.append(0)
                        self.long.append(False)
                    at = nxt
                    path.append(at)
                self.end[at] = self.end[at] or kind
                if kind == 1 and len(w) >= FUZZY_FROM:
                    for k in path:
                        self.long[k] = True
        self.depth = [0] * len(self.child)
        for k, kids in enumerate(self.child):
            for v in kids.values():
                self.depth[v] = self.depth[k] + 1
        self.start = self._close({(0, 0, "")})
        self.ids = {self.start: 0}
        self.states = [self.start]
        self.step: list[dict[str, int]] = [{}]
        self.accept: list[int] = [self._verdict(self.start)]

    def _close(self, items: set) -> frozenset:
        """With the states reached by deleting a letter of the entry."""
        out = set(items)
        for node, edits, held in items:
            if edits == 0 and not held:
                out.update((k, 1, "") for k in self.child[node].values() if self.long[k])
        return frozenset(out)

    def _next(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, edits, held in state:
            if node < 0:
                out.add((-1, 0, ""))                            # behind a stem
                continue
            if held:                                            # second letter of a swap
                if c == held:
                    out.add((node, 1, ""))
                continue
            k = self.child[node].get(c)
            if k is not None:
                out.add((k, edits, ""))
                if edits == 0 and self.end[k] == 2:
                    out.add((-1, 0, ""))
            if edits == 0 and self.long[node]:
                out.add((node, 1, ""))                          # a letter too many
                for d, k in self.child[node].items():
                    if d != c and self.long[k]:
                        out.add((k, 1, ""))                     # another letter
                        far = self.child[k].get(c)
                        if far is not None and self.long[far]:
                            out.add((far, 1, d))                # c stands before d: a swap
        return self._close(out)

    def _verdict(self, state: frozenset) -> int:
        if any(n >= 0 and e == 0 and not h and self.end[n] == 1 for n, e, h in state):
            return self.EXACT
        if any(n < 0 or (e == 0 and not h and self.end[n] == 2) for n, e, h in state):
            return self.STEMMED
        if any(n >= 0 and e == 1 and not h and self.end[n] == 1 and self.depth[n] >= FUZZY_FROM
               for n, e, h in state):
            return self.FUZZY
        return 0

    def _go(self, at: int, c: str) -> int:
        state = self._next(self.states[at], c)
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.step.append({})
            self.accept.append(self._verdict(state))
        self.step[at][c] = self.ids[state]
        return self.ids[state]

    def match(self, word: str) -> int:
        at, step = 0, self.step
        for c in word:
            to = step[at].get(c)
            if to is None:
                to = self._go(at, c)
            at = to
            if not self.states[at]:
                return 0
        return self.accept[at]


def _quoted(text: str, start: int, end: int, words_before: list[str]) -> bool:
    """A match in the middle of quotation marks on its line, or behind a reporting word."""
    line_start, line_end = text.rfind("\n", max(0, start - 400), start) + 1, text.find("\n", end, end + 400)
    before = text[max(line_start, start - 200):start]
    after = text[end:line_end if line_end >= 0 else end + 200]
    if len(_QUOTE.findall(before)) % 2 == 1 and _QUOTE.search(after):
        return True
    return any(w in REPORTING for w in words_before)


N_FEATURES = 8


def matches(low: str, words: set[str], automaton: Automaton, ordinary=frozenset()):
    """(kind, form, start, end, words before) of every match in a lower-cased text.
    ``words`` are its distinct words. Entries are letters only, so a word with one digit
    or symbol inside can be a misspelled entry; its parts are looked at first. Misspelled
    forms in ``ordinary`` are no matches."""
    match = automaton.match
    kinds = {w: k for w in words if (k := match(w)) and (k != automaton.FUZZY or w not in ordinary)}
    joined = {a + c + b for a, c, b in set(_JOINED.findall(low))
              if a not in kinds and b not in kinds and match(a + c + b) == automaton.FUZZY} - ordinary
    if not kinds and not joined:
        return
    at = {m.start(): (m[1] + m[2] + m[3], m.end(3)) for m in _JOINED.finditer(low)
          if m[1] + m[2] + m[3] in joined} if joined else {}
    before: list[str] = []
    for m in _WORD.finditer(low):
        w = m.group()
        if w in kinds:
            yield kinds[w], w, m.start(), m.end(), before[-WINDOW:]
        elif m.start() in at:
            form, end = at[m.start()]
            yield automaton.FUZZY, form, m.start(), end, before[-WINDOW:]
        before.append(w)
        if len(before) > 4 * WINDOW:
            del before[:-WINDOW]


def features(text: str, automaton: Automaton, ordinary=frozenset()) -> list[float]:
    """Bias; matches by kind, plain and quoted, damped by log; density of plain ones."""
    low = text.lower()
    words = set(_WORD.findall(low))
    plain, quoted = [0, 0, 0, 0], 0
    for kind, _, start, end, before in matches(low, words, automaton, ordinary):
        if _quoted(low, start, end, before):
            quoted += 1
        else:
            plain[kind] += 1
    total = plain[1] + plain[2]
    return [1.0, float(plain[1] > 0), math.log1p(plain[1]), float(plain[2] > 0), math.log1p(plain[2]),
            math.log1p(plain[3]), math.log1p(quoted), min(1.0, 50 * total / (len(words) + 1))]


def misspelled(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` with plain terms as they would be if every term were misspelled."""
    x = x[x[:, 1] > 0].copy()
    x[:, 5] = np.log1p(np.expm1(x[:, 2]) + np.expm1(x[:, 5]))
    x[:, 7] *= np.expm1(x[:, 4]) / (np.expm1(x[:, 2]) + np.expm1(x[:, 4]))
    x[:, 1:3] = 0
    return x


class Model:
    def __init__(self, terms: list[str], stems: list[str], weights: np.ndarray, ordinary=frozenset()):
        self.terms, self.stems, self.weights, self.ordinary = terms, stems, weights, ordinary

    def automaton(self) -> Automaton:
        return Automaton(self.terms, self.stems)

    def scores(self, texts: list[str], automaton: Automaton) -> np.ndarray:
        x = np.array([features(t, automaton, self.ordinary) for t in texts]).reshape(len(texts), N_FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, shrink: float = 0.02) -> np.ndarray:
    """Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], shrink * len(y) / 100 + 0.05)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(h, g)
    return w


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_fold: int,
             limit: int) -> DataFrame:
    """(id, text, y) of at most ``limit`` labelled documents outside the held-out fold, in
    the order of a hash of the id. An id labelled twice keeps its larger label; rows with
    a null id, label or text are not used."""
    marks = (labels.where((fold(id_col) != held_fold) & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(limit))
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .where("text is not null").join(F.broadcast(marks), "id"))


def lexicon(rows: DataFrame, max_terms: int = MAX_TERMS) -> tuple[list[str], list[str]]:
    """(terms, stems). Terms are used in at least MIN_CONTEXTS contexts (different words
    before) of toxic rows and their odds favour toxic rows; contexts, unlike documents,
    do not grow with copies of one text. Stems are beginnings of four or more words
    whose contexts together have such odds; a stem inside a longer one is left out.
    Counted in Spark; at most ``max_terms`` rows of each return."""
    word = F.expr("regexp_extract_all(lower(text), '\\\\p{L}+', 0)")
    pairs = (rows.select("y", "id", word.alias("w"))
             .select("y", "id", F.explode(F.arrays_zip(F.col("w"), F.expr(
                 "concat(array(''), slice(w, 1, greatest(size(w) - 1, 0)))").alias("b"))).alias("p"))
             .select("y", "id", F.col("p.w").alias("w"), F.col("p.b").alias("b")).where("w is not null"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count_distinct("id").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return [], []
    per = stored(pairs.groupBy("w").agg(
        F.count_distinct(F.when(F.col("y") == 1, F.col("b"))).alias("contexts"),
        F.count_distinct(F.when(F.col("y") == 0, F.col("b"))).alias("others")), "toxic-words")
    odds = F.log((F.col("contexts") + 0.5) / (n[1] + 1)) - F.log((F.col("others") + 0.5) / (n[0] + 1))
    best = F.desc(F.col("odds") * F.log1p("contexts"))
    terms = (per.select("w", "contexts", odds.alias("odds"))
             .where(f"contexts >= {MIN_CONTEXTS} and odds >= {MIN_ODDS}").orderBy(best, "w").limit(max_terms))
    heads = (per.select("contexts", "others", F.explode(F.expr(
        f"transform(sequence({STEM}, greatest({STEM}, least({STEM_END}, length(w) - 1))), k -> substr(w, 1, k))"))
        .alias("w"), F.length("w").alias("n")).where(f"n > {STEM}")
        .groupBy("w").agg(F.sum("contexts").alias("contexts"), F.sum("others").alias("others"),
                          F.sum((F.col("contexts") > F.col("others")).cast("int")).alias("words")))
    stems = (heads.select("w", "contexts", "words", odds.alias("odds"))
             .where(f"words >= 4 and contexts >= {4 * MIN_CONTEXTS} and odds >= {MIN_ODDS}")
             .orderBy(best, "w").limit(max_terms))
    found = {r["w"] for r in stems.collect()}
    return ([r["w"] for r in terms.collect()],
            sorted(x for x in found if not any(x[:k] in found for k in range(STEM, len(x)))))


def near_forms(rows: DataFrame, terms: list[str], stems: list[str]) -> dict[str, int]:
    """Misspelled forms of terms that are ordinary words by the labelled rows (used in
    other rows, and their odds do not favour toxic ones), with their contexts there."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count_distinct("id").alias("n")).collect()}

    def run(batches):
        automaton = Automaton(terms, stems)
        for b in batches:
            out = []
            for y, text in zip(b.column(0).to_pylist(), strings(b)):
                low = text.lower()
                out += {(y, form, before[-1] if before else "")
                        for kind, form, _, _, before in matches(low, set(_WORD.findall(low)), automaton)
                        if kind == automaton.FUZZY}
            yield pa.RecordBatch.from_pylist([{"y": y, "w": w, "b": p} for y, w, p in out], pa.schema(
                [("y", pa.int32()), ("w", pa.string()), ("b", pa.string())]))
            if len(automaton.states) > 200_000:
                automaton = Automaton(terms, stems)

    per = rows.select("y", "text").mapInArrow(run, "y int, w string, b string").groupBy("w").agg(
        F.count_distinct(F.when(F.col("y") == 1, F.col("b"))).alias("contexts"),
        F.count_distinct(F.when(F.col("y") == 0, F.col("b"))).alias("others"))
    odds = F.log((F.col("contexts") + 0.5) / (n[1] + 1)) - F.log((F.col("others") + 0.5) / (n[0] + 1))
    return {r["w"]: r["others"] for r in per.where((F.col("others") > 0) & (odds < MIN_ODDS)).collect()}


FIT_DOCS = 3000         # of the sample, so many fit the weights; their features are computed on whole texts


def fit_rows(rows: DataFrame, terms: list[str], stems: list[str], often: frozenset, limit: int = FIT_DOCS):
    """Features and labels of at most ``limit`` documents, half of each label, the first by a
    hash of the id; one row an id. Only the features reach the driver."""
    chosen = rows.select("y", "id").distinct().withColumn("n", F.row_number().over(
        Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))).where(F.col("n") <= limit // 2).select("y", "id")
    some = rows.join(F.broadcast(chosen), ["y", "id"]).select("y", "text", "id")
    kind = some.schema["id"].dataType.simpleString()

    def run(batches):
        automaton = Automaton(terms, stems)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([list(map(float, features(t, automaton, often))) for t in strings(b)], pa.list_(pa.float64()))],
                names=["y", "id", "x"])
            if len(automaton.states) > 200_000:
                automaton = Automaton(terms, stems)

    found = some.mapInArrow(run, f"y int, id {kind}, x array<double>").groupBy("y", "id").agg(F.min("x").alias("x")).collect()
    return sorted((tuple(r["x"]), r["y"]) for r in found)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", held_fold: int = 1, limit: int = SAMPLE_DOCS) -> Model:
    """Lexicon and weights from labelled documents outside the held-out fold. The toxic
    and the other documents of the fit weigh as they are found, and those with terms once more
    as if misspelled, which labelled rows seldom show; without both labels every score is
    0.5. A near form used once in other rows counts in the fit, as an unseen one will."""
    rows = labelled(docs, labels, id_col, text_col, label_col, held_fold, limit)
    terms, stems = lexicon(rows)
    near = near_forms(rows, terms, stems) if terms or stems else {}
    often = frozenset(w for w, others in near.items() if others > 1)
    fit = fit_rows(rows, terms, stems, often)
    if len({y for _, y in fit}) < 2:
        return Model(terms, stems, np.zeros(N_FEATURES))
    x, y = np.array([r for r, _ in fit]), np.array([y for _, y in fit], float)
    w = _logistic(np.concatenate([x, misspelled(x)]), np.concatenate([y, y[x[:, 1] > 0]]))
    return Model(terms, stems, w, frozenset(near))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_fold: int = 1,
          least: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. Null and empty texts
    score as texts without a match; a null id is not held out; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)     # at most MAX_TERMS terms

    def run(batches):
        automaton = shared.value.automaton()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(shared.value.scores(strings(part), automaton), pa.float64())],
                    names=["id", "score"])
                if len(automaton.states) > 200_000:              # words of any kind make states: start anew
                    automaton = shared.value.automaton()

    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select("id", F.coalesce(fold("id") == held_fold, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= least).cast("int").alias("predicted"))
