"""Dictionaries of any size as tables.

Short dictionaries are constants inside expressions (functions/text.py, functions/fuzzy.py).
Here a dictionary is a DataFrame (keyword, ord) that meets the texts in equi-joins, so its
size is bounded by nothing but the cluster:

* whole words: word n-grams of the lengths that the dictionary has, equal to a keyword;
* substrings: at each place of a text the substrings of the lengths that keywords with the
  next 3 signs have, equal to a keyword;
* fuzzy titles: substrings, shared words (of each word only the first k keywords can be
  among the k best) and, only where fewer than k were found, edit distance under bounds.

Dictionary tables are written first, so their size in bytes is known when the joins are
planned: small ones are broadcast, larger ones are shuffled. Keywords are literal text,
compared in lower case; empty ones are left out, and of equal ones the first counts where
only one can be reported.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesift.functions.fuzzy import process_fuzzy, with_fuzzy_query
from sitesift.functions.text import clean_text
from sitesift.session import deal, stored

__all__ = ["title_table", "exact_titles", "containment", "keywords_of", "holding_any", "fuzzy_titles", "ROW"]

_WORD = r"\p{L}\p{M}\p{N}_"
TOKEN = rf"[{_WORD}]++|[^{_WORD}]"
ROW = "_row"                # number of an input row, unique
PIECE = 16_384              # tokens of a text that are expanded together
GRAM = 3
CUT = 64                    # signs of a keyword that are compared in a join
STRETCH = 1024              # places of a text that are expanded together
BLOCK = 1 << 17             # keywords compared by edit distance at once
STRETCHES = 1 << 17         # signs of texts that are walked together
SMALL = 256 << 20           # bytes of a dictionary that every worker may hold
MATCHER = 48 << 20          # characters of a dictionary that every worker may hold for fuzzy titles
EARLY = 1 << 11, 1 << 14    # so many first keywords are looked for at once
WORDS = 1 << 18             # words of texts that a worker remembers with the keywords they hold


def title_table(dictionary: DataFrame) -> DataFrame:
    """(keyword, ord), written; null and empty keywords left out."""
    d = dictionary.select(F.col("keyword").cast("string"), F.col("ord").cast("long"))
    return stored(d.where(F.length("keyword") > 0), "dictionary")


def _dealt(texts: DataFrame) -> DataFrame:
    """``deal`` by a number of the row: dealt out in turn, texts are sorted before, on disk where
    they are many."""
    return deal(texts.withColumn("_deal", F.monotonically_increasing_id()), "_deal").drop("_deal")


# ---- whole words -----------------------------------------------------------------------

def exact_titles(df: DataFrame, text: Column, dictionary: DataFrame, ids=("page_id", "url")) -> DataFrame:
    """(ids..., pos, value): non-overlapping whole-word occurrences of keywords in the cleaned
    text, left to right, as a case-insensitive alternation in dictionary order finds them: at
    one place the keyword with the smallest ``ord`` that ends at a word boundary wins.
    A dictionary of at most SMALL bytes is broadcast and each text walked once, token by
    token; a larger one meets the texts' n-grams in joins.

    A keyword's first and last sign must lie at a word boundary. Null and empty texts give
    nothing; equal rows give equal matches. ``pos`` numbers a text's matches from 0.
    """
    tokens = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    words = (title_table(dictionary).select(F.lower("keyword").alias("gram"), "ord").groupBy("gram").agg(F.min("ord").alias("ord"))
             .withColumn("t", tokens(F.col("gram"))).withColumn("m", F.size("t")).withColumn("first", F.col("t")[0]))
    words = stored(words.drop("t"), "dictionary-words")
    longest, size = words.agg(F.max("m"), F.sum(F.octet_length("gram") + 48)).first()
    longest = longest or 1
    schema = T.StructType([*(df.select(*ids).schema.fields), T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())])
    if (size or 0) <= SMALL:
        # texts are few bytes beside the work on them: a small table comes as one split
        return _walk(_dealt(df.select(*ids, text.alias("_text"))).withColumn("_text", clean_text("_text")), words, schema)
    firsts = stored(words.groupBy("first").agg(F.sort_array(F.collect_set("m")).alias("ms")), "dictionary-firsts")
    rows = df.select(*ids, F.monotonically_increasing_id().alias(ROW), tokens(clean_text(text)).alias("_t"))
    # a long text in pieces, each with the tokens that a match at its end needs, and one before it
    rows = rows.select(*ids, ROW, F.explode(F.expr(
        f"transform(sequence(0, greatest(size(_t) - 1, 0) div {PIECE}), p -> named_struct('at', p * {PIECE}, "
        f"'n', least({PIECE}, size(_t) - p * {PIECE}), 'before', if(p = 0, '', _t[p * {PIECE} - 1]), "
        f"'t', slice(_t, p * {PIECE} + 1, {PIECE} + {longest})))")).alias("_p"))
    at = F.explode(F.expr(
        "transform(filter(sequence(0, _p.n - 1), i -> _p.n > 0), i -> named_struct('pos', _p.at + i, 'first', lower(_p.t[i]), "
        f"'before', if(i = 0, _p.before, _p.t[greatest(i - 1, 0)]), 'run', slice(_p.t, i + 1, {longest + 1})))")).alias("_at")
    rows = rows.select(*ids, ROW, at).select(*ids, ROW, "_at.*")
    rows = rows.join(firsts, "first").select(*ids, ROW, "pos", "before", "run", F.explode("ms").alias("m")).where("m <= size(run)")
    rows = (rows.withColumn("value", F.array_join(F.slice("run", F.lit(1), F.col("m")), ""))
            .withColumn("gram", F.lower("value")).join(words.drop("first"), ["gram", "m"]))
    is_word = lambda c: c.rlike(rf"^[{_WORD}]")
    last, after = F.col("run")[F.col("m") - 1], F.coalesce(F.get("run", F.col("m")), F.lit(""))
    starts = is_word(F.substring("value", 1, 1)) | is_word(F.col("before"))
    ends = is_word(last) | is_word(after)
    found = rows.where(starts & ends).select(*ids, ROW, "pos", "m", "ord", "value")
    n = len(ids)

    def leftmost(batches):
        """Of matches sorted by text and place, one after the other: at each place free of
        earlier ones the smallest ``ord``."""
        from itertools import chain

        import pyarrow as pa

        row, free, number, rest = None, 0, 0, None
        for b in chain(batches, [None]):
            t = b if rest is None else rest if b is None else pa.concat_batches([rest, b])      # the end comes as None
            if t is None:
                return
            rows, places, sizes, orders = (t.column(n + k).to_pylist() for k in range(4))
            keep, numbers, i = [], [], 0
            while i < len(rows):
                j = i + 1
                while j < len(rows) and places[j] == places[i] and rows[j] == rows[i]:
                    j += 1
                if j == len(rows) and b is not None:         # more of this place may come
                    break
                if rows[i] != row:
                    row, free, number = rows[i], 0, 0
                if places[i] >= free:
                    best = min(range(i, j), key=orders.__getitem__)
                    keep.append(best)
                    numbers.append(number)
                    free, number = places[i] + sizes[best], number + 1
                i = j
            rest = t.slice(i)
            if keep:
                kept = t.take(pa.array(keep, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:n], pa.array(numbers, pa.int32()), kept.column(n + 4)],
                                                 names=[*t.schema.names[:n], "pos", "value"])

    return found.repartition(ROW).sortWithinPartitions(ROW, "pos").mapInArrow(leftmost, schema)


def _mixed(x):
    """Bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB
    return x ^ (x >> 31)


def _powers(base: int, n: int):
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    import numpy as np

    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Signs (UTF-16 units), any span of which has a hash: a difference of prefix sums."""
    BASE = 0x9E3779B97F4A7C15
    tables = None

    def __init__(self, units):
        import numpy as np

        n = len(units)
        if Spans.tables is None or len(Spans.tables[1]) < n:
            size = max(n, 1 << 17)
            Spans.tables = (_mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64)), _powers(self.BASE, size), _powers(pow(self.BASE, -1, 1 << 64), size))
        signs, up, self.down = Spans.tables
        self.units, self.sums = units, np.zeros(n + 1, np.uint64)
        np.cumsum(signs[units] * up[:n], out=self.sums[1:])

    def hashes(self, starts, ends):
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def units_of(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def _places(starts, sizes):
    """starts[i] .. starts[i] + sizes[i] - 1 of every i, one after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Strings:
    """Different strings, found by spans of other texts: some 30 bytes a string besides its signs
    and no Python object, so that a worker can hold millions. Strings whose hash is that of
    the span are compared sign by sign."""

    def __init__(self, strings: list[str]):
        import numpy as np

        n, parts, sizes, hashes = len(strings), [], [], []
        for lo in range(0, n, BLOCK):
            some = [units_of(x) for x in strings[lo:lo + BLOCK]]
            size = np.array([len(x) for x in some], np.int64)
            units, ends = np.concatenate(some), np.cumsum(size)
            parts.append(units)
            sizes.append(size)
            # strings after each other would need long tables: a few at once
            cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(some)]
            for a, b in zip(cuts, cuts[1:]):
                at = ends[a] - size[a]
                hashes.append(Spans(units[at:ends[b - 1]]).hashes(ends[a:b] - size[a:b] - at, ends[a:b] - at) if b > a else np.zeros(0, np.uint64))
        self.units = np.concatenate([*parts, np.zeros(0, np.uint16)])
        self.sizes = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        bits = max(n, 2).bit_length()
        self.shift = np.uint64(64 - bits)
        self.heads = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, spans: Spans, starts, ends):
        """The number of the string that equals each span, or -1."""
        import numpy as np

        hashes, found = spans.hashes(starts, ends), np.full(len(starts), -1, np.int32)
        slot = hashes >> self.shift
        at = self.heads[slot]
        rest = np.flatnonzero(at < self.heads[slot + np.uint64(1)])
        at, last, wanted = at[rest], self.heads[slot[rest] + np.uint64(1)], hashes[rest]
        while len(rest):
            hit = np.flatnonzero(self.hashes[at] == wanted)
            k, i = self.order[at[hit]], rest[hit]
            sizes = ends[i] - starts[i]
            fits = (sizes == self.sizes[k]) & (sizes > 0)
            k, i, sizes = k[fits], i[fits], sizes[fits]
            if len(i):
                same = spans.units[_places(starts[i], sizes)] == self.units[_places(self.starts[k], sizes)]
                same = np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)
                found[i[same]] = k[same]
            at = at + 1
            more = (at < last) & (found[rest] < 0)
            rest, at, last, wanted = rest[more], at[more], last[more], wanted[more]
        return found


def _as_data(x):
    """An object of this module's classes as plain data: broadcasts are pickled by name."""
    return (type(x).__name__, {k: _as_data(v) for k, v in vars(x).items()}) if isinstance(x, (Strings, Walker, Matcher)) else x


def _from_data(x, classes=None):
    classes = classes or {c.__name__: c for c in (Strings, Walker, Matcher)}
    if not (isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], str) and x[0] in classes):
        return x
    out = object.__new__(classes[x[0]])
    vars(out).update({k: _from_data(v, classes) for k, v in x[1].items()})
    return out


def _signs():
    """Of signs of one UTF-16 unit whether they are word signs and their lower case; a pattern
    of the others and of those whose lower case is another for the signs around."""
    import numpy as np
    import regex

    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 1 << 16))]
    word, lower, odd = np.zeros(1 << 16, bool), np.arange(1 << 16, dtype=np.uint16), [r"\u03a3", r"\ud800-\udfff", r"\U00010000-\U0010ffff"]
    word[[ord(c) for c in regex.findall(f"[{_WORD}]", "".join(every))]] = True
    for c in every:
        low = c.lower()
        if low != c:
            if len(low) == 1 and ord(low) < 1 << 16:
                lower[ord(c)] = ord(low)
            else:
                odd.append(f"\\u{ord(c):04x}")
    return word, lower, "[" + "".join(odd) + "]"


class Walker:
    """Whole words of a dictionary (gram, ord, first token, number of tokens) in texts."""

    def __init__(self, grams, orders, firsts, sizes):
        import numpy as np

        self.grams, self.orders, self.signs = Strings(grams), np.array(orders, np.int64), _signs()
        pairs = sorted(set(zip(firsts, sizes)))
        heads = list(dict.fromkeys(f for f, _ in pairs))
        self.firsts, self.sizes = Strings(heads), np.array([m for _, m in pairs], np.int32)
        at = {f: i for i, f in enumerate(heads)}
        self.counts = np.bincount([at[f] for f, _ in pairs], minlength=len(heads)).astype(np.int32)
        self.begins = np.cumsum(self.counts) - self.counts

    def walk(self, texts: list[str]):
        """(number of the text, pos, value) of all matches as lists, text by text."""
        import re

        odd = re.compile(self.signs[2])
        easy = [t.isascii() or not odd.search(t) for t in texts]
        out = [], [], []
        for kind in (True, False):
            some = [i for i, e in enumerate(easy) if e == kind]
            if some:
                rows, pos, values = self._walk([texts[i] for i in some], kind)
                out[0].extend(some[r] for r in rows)
                out[1].extend(pos)
                out[2].extend(values)
        return out

    def _walk(self, texts, easy: bool):
        """Texts behind each other, a sign between them that is a token in itself."""
        import numpy as np

        word, lower, _ = self.signs
        whole = "\0".join(texts)
        if easy:
            units = units_of(whole)
            inside = word[units]
            starts = np.flatnonzero(~(inside & np.concatenate([[False], inside[:-1]])))
            ends = np.append(starts[1:], len(units)) if len(starts) else starts
            inside, low, marks = inside[starts], lower[units], (starts, ends)
        else:
            import regex

            token = regex.compile(TOKEN)
            tokens = token.findall(whole)
            lows = [t.lower() for t in tokens]
            sizes = np.array([len(units_of(t)) for t in lows], np.int64)
            ends, shown = np.cumsum(sizes), np.cumsum([len(t) for t in tokens])
            starts, marks = ends - sizes, (shown - [len(t) for t in tokens], shown)
            inside, low = np.array([not token.fullmatch(t + "a") is None for t in tokens], bool), units_of("".join(lows))
        between = np.cumsum([len(t) + 1 for t in texts[:-1]]) - 1                # where the signs between texts are shown
        break_ = np.isin(marks[0], between) if len(between) else np.zeros(len(starts), bool)
        text = np.cumsum(break_)
        spans, n = Spans(low), len(starts)
        first = self.firsts.find(spans, starts, ends)
        at = np.flatnonzero((first >= 0) & ~break_)
        counts = self.counts[first[at]]
        sizes = self.sizes[_places(self.begins[first[at]], counts)]
        at = np.repeat(at, counts)
        last = at + sizes - 1
        fits = last < n
        at, last = at[fits], last[fits]
        # texts end at a break, which is no word; so do all
        around = np.concatenate([[False], inside, [False]])
        fits = (text[last] == text[at]) & (inside[at] | around[at]) & (inside[last] | around[last + 2])
        at, last = at[fits], last[fits]
        gram = self.grams.find(spans, starts[at], ends[last])
        fits = gram >= 0
        at, last, order = at[fits], last[fits], self.orders[gram[fits]]
        if len(at) and (at[1:] == at[:-1]).any():
            by = np.lexsort((last, order, at))
            by = by[np.concatenate([[True], at[by][1:] != at[by][:-1]])]
            at, last = at[by], last[by]
        free, keep = 0, []
        for i, (a, z) in enumerate(zip(at.tolist(), last.tolist())):
            if a >= free:
                keep.append(i)
                free = z + 1
        at, last = at[keep], last[keep]
        rows = text[at]
        news = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else rows
        pos = np.arange(len(rows)) - np.repeat(news, np.diff(np.append(news, len(rows))))
        values = [whole[a:z] for a, z in zip(marks[0][at].tolist(), marks[1][last].tolist())]
        return rows.tolist(), pos.tolist(), values


def _walk(rows: DataFrame, words: DataFrame, schema) -> DataFrame:
    """``exact_titles`` with a broadcast dictionary: (ids..., text) -> (ids..., pos, value)."""
    held = words.where("ord IS NOT NULL").select("gram", "ord", "first", "m").toArrow()
    walker = Walker(*(held.column(c).to_pylist() for c in ("gram", "ord", "first", "m")))
    shared = rows.sparkSession.sparkContext.broadcast(_as_data(walker))
    n = len(rows.columns) - 1

    def run(batches):
        import pyarrow as pa

        walker = _from_data(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(n).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) < STRETCHES:
                    size, hi = size + len(texts[hi]), hi + 1
                at, pos, value = walker.walk(texts[lo:hi])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(at, pa.int32())) for c in part.columns[:n]), pa.array(pos, pa.int32()), pa.array(value, pa.string())],
                    names=schema.names)
                lo = hi

    return rows.mapInArrow(run, schema)


# ---- substrings ------------------------------------------------------------------------

def containment(texts: DataFrame, text_col: str, keywords: DataFrame, id_col: str = ROW, key_col: str = "ord",
                keyword_col: str = "keyword") -> DataFrame:
    """(id, key): texts that hold a keyword as a substring, both as given (lower both first
    to ignore case). ``texts`` should be a written table with unique ids: it is read twice.

    At each place of a text its next 3 signs say which lengths keywords that start so have;
    the substrings of these lengths equal keywords or don't. So a text meets the keywords it
    holds and few others, however many there are. Of keywords over CUT signs the first CUT
    meet the texts, then ``contains`` decides.
    """
    words = keywords.select(F.col(key_col).alias("_key"), F.col(keyword_col).alias("_kw")).where(F.length("_kw") > 0)
    words = stored(words.withColumn("_cut", F.substring("_kw", 1, CUT)), "keywords")
    longest, sizes = words.agg(F.max(F.length("_kw")), F.collect_set(F.least(F.length("_kw"), F.lit(GRAM)))).first()
    if not sizes:
        return texts.select(id_col).limit(0).withColumn(key_col, F.lit(None).cast(keywords.schema[key_col].dataType))
    heads = stored(words.groupBy(F.substring("_cut", 1, GRAM).alias("_head"))
                   .agg(F.sort_array(F.collect_set(F.length("_cut"))).alias("_ms")), "keyword-heads")
    whole = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    # long texts in pieces, each with the signs that a match at its end needs
    rows = whole.select("_id", F.explode(F.expr(
        f"transform(sequence(0, (length(_text) - 1) div {STRETCH}), p -> substring(_text, p * {STRETCH} + 1, {STRETCH + CUT - 1}))")).alias("_t"))
    rows = rows.select("_id", "_t", F.explode(F.expr(f"sequence(1, least(length(_t), {STRETCH}))")).alias("_at"))
    rows = rows.select("_id", "_t", "_at", F.explode(F.array(*[F.lit(n) for n in sorted(sizes)])).alias("_n"))
    rows = rows.where("_at + _n - 1 <= length(_t)").withColumn("_head", F.expr("substring(_t, _at, _n)")).join(heads, "_head")
    rows = rows.select("_id", "_t", "_at", F.explode("_ms").alias("_m")).where("_at + _m - 1 <= length(_t)")
    # of equal substrings of a piece the first
    rows = rows.withColumn("_cut", F.expr("substring(_t, _at, _m)")).where("instr(_t, _cut) = _at").select("_id", "_cut")
    found = rows.join(words, "_cut")
    held = found.where(F.length("_kw") <= CUT).select("_id", "_key")
    if longest > CUT:
        more = found.where(F.length("_kw") > CUT).select("_id", "_key", "_kw").join(whole, "_id").where(F.contains("_text", "_kw"))
        held = held.unionByName(more.select("_id", "_key"))
    if (texts.agg(F.max(F.length(text_col))).first()[0] or 0) > STRETCH:
        held = held.distinct()
    return held.select(F.col("_id").alias(id_col), F.col("_key").alias(key_col))


def numbered(strings: DataFrame, col: str) -> DataFrame:
    """The distinct strings of a column as a written table with a number each."""
    return stored(strings.select(col).where(F.length(col) > 0).distinct().withColumn(ROW, F.monotonically_increasing_id()), "strings")


def keywords_of(strings: DataFrame, col: str, keywords: DataFrame, keyword_cols=("keyword",)) -> DataFrame:
    """(col, keyword columns...): distinct strings of a column with the distinct keywords that
    they hold (of equal keywords the one with the smallest ``ord``); written, so that a
    frequent string on the other side of a join can be split."""
    once = numbered(strings, col)
    keywords = keywords.groupBy("keyword").agg(F.min_by(F.struct(*[c for c in keywords.columns if c != "keyword"]), "ord").alias("_first"))
    keywords = keywords.select("keyword", "_first.*")
    held = containment(once, col, keywords.select(F.struct(*keyword_cols).alias("key"), "keyword"), key_col="key")
    return stored(once.join(held, ROW).select(col, "key.*"), "held-keywords")


def holding_any(strings: DataFrame, col: str, keywords: DataFrame) -> DataFrame:
    """The distinct strings of a column that hold any keyword."""
    once = numbered(strings, col)
    held = containment(once, col, keywords.select("keyword").distinct().withColumn("key", F.lit(True)), key_col="key")
    return stored(once.join(held.select(ROW).distinct(), ROW).select(col), "holding")


# ---- fuzzy titles ----------------------------------------------------------------------

def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one column of the table in a machine word (bit-parallel)."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(xh | up) & full, up & xh
        score += bool(right & top) - bool(left & top)
        right = (right << 1 | 1) & full
        up, down = (left << 1 | ~(xv | right)) & full, right & xv
    return score


def _score(distance: int, longer: int) -> int:
    from decimal import ROUND_HALF_UP, Decimal

    x = 100.0 * (1.0 - distance / longer)
    return min(56, int(Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP)))


def _letter_counts(words: list[str]):
    import numpy as np

    out = np.zeros((len(words), 37), np.int16)
    for i, w in enumerate(words):
        for c in w:
            out[i, 36 if c == " " else ord(c) - 97 if c >= "a" else 26 + ord(c) - 48] += 1
    return out


def nearest(query: str, words: list[str], sizes, counts, order, skip: set, k: int, min_score: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, index) by edit distance alone, ties by ``order``; only keywords
    whose length allows more than ``min_score``. Candidates come in the order of an upper
    bound (letters that must be added or removed), until it falls below the k-th score."""
    import numpy as np

    n = len(query)
    fits = np.flatnonzero(200 * np.minimum(sizes, n) >= (2 * min_score + 1) * np.maximum(sizes, n))
    if not len(fits):
        return []
    gap = counts[fits].astype(np.int32) - _letter_counts([query])[0]
    least = np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1))
    longer = np.maximum(sizes[fits], n)
    bound = np.minimum(56.0, np.floor(100.0 * (1.0 - least / longer) + 0.5 + 1e-9))
    best: list[tuple[int, int, int]] = []                    # (-score, order, index), sorted
    for j in np.lexsort((order[fits], -bound)).tolist():
        i = int(fits[j])
        if bound[j] <= min_score or (len(best) == k and -best[-1][0] > bound[j]):
            break
        if i in skip or (len(best) == k and -best[-1][0] == bound[j] and order[i] > best[-1][1]):
            continue
        s = _score(edit_distance(query, str(words[i])), int(longer[j]))
        if s > min_score:
            best = sorted([*best, (-s, int(order[i]), i)])[:k]
    return [(-s, i) for s, _, i in best]


def fuzzy_titles(df: DataFrame, text: Column, dictionary: DataFrame, ids=("page_id", "url"), k: int = 5, min_score: int = 30,
                 all_windows: bool = False) -> DataFrame:
    """(ids..., rk, value, score): the ``k`` best keywords of each text by the tiered score of
    functions/fuzzy.py, ties in dictionary order; the same answers as scoring every keyword.

    A dictionary of at most MATCHER characters is broadcast (see ``Matcher``); a larger one is
    joined."""
    spark = df.sparkSession
    words = title_table(dictionary).withColumn("kp", process_fuzzy(F.col("keyword"))).where("kp <> ''")
    # keywords that are processed alike score alike: only the first k of them can be among the k best
    alike = Window.partitionBy("kp").orderBy("ord", "keyword")
    words = stored(words.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k).drop("n"), "fuzzy-words")
    if (words.agg(F.sum(F.length("kp") + 4)).first()[0] or 0) <= MATCHER:
        # texts are few bytes beside the work on them: a small table comes as one split
        texts = _dealt(df.select(*ids, text.alias("_text"))).select(*ids, clean_text("_text").alias("_text"))
        return _by_matcher(texts, words, ids, k, min_score, all_windows)
    rows = with_fuzzy_query(df.withColumn(ROW, F.monotonically_increasing_id()), text, all_windows)
    rows = stored(rows.select(*ids, ROW, F.col("_fuzzy_q").alias("q")).where("q <> ''"), "fuzzy-queries")
    # 60: the keyword is a substring of the query
    held = containment(rows, "q", words.select(F.struct("ord", "keyword", "kp").alias("key"), "kp"), key_col="key", keyword_col="kp")
    found = held.select(ROW, "key", F.lit(60).alias("score"))
    # 57: they share a word; of the keywords with a word only the first k can be among the k best
    own = (words.where(F.contains("kp", F.lit(" "))).select(F.struct("ord", "keyword", "kp").alias("key"), "ord", "keyword",
                                                            F.explode(F.array_distinct(F.split("kp", " "))).alias("w")).where("w <> ''"))
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("w").orderBy("ord", "keyword"))).where(F.col("n") <= k)
    first = stored(first.select("w", "key"), "fuzzy-shared")
    shared = rows.select(ROW, F.explode(F.array_distinct(F.split("q", " "))).alias("w")).join(first, "w")
    found = found.unionByName(shared.select(ROW, "key", F.lit(57).alias("score")))
    found = found.groupBy(ROW, "key").agg(F.max("score").alias("score"))
    rank = Window.partitionBy(ROW).orderBy(F.desc("score"), "key.ord", "key.keyword")
    best = stored(found.withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k), "fuzzy-best")
    # below: only for texts with fewer than k, and short enough for a keyword to come near
    reach = words.agg(F.max(F.length("kp"))).first()[0] or 0
    short = rows.where((2 * min_score + 1) * F.length("q") <= 200 * reach)
    have = best.groupBy(ROW).agg(F.collect_list("key.ord").alias("have"))            # at most k each
    open_ = short.join(have, ROW, "left").where((F.size(F.coalesce("have", F.array())) < k) & (F.lit(min_score) < 56))
    open_ = stored(open_.select(ROW, "q", F.coalesce("have", F.array().cast("array<long>")).alias("have")), "fuzzy-open")
    more = []
    if min_score < 56 and not open_.isEmpty():
        blocks = -(-words.count() // BLOCK)
        for b in range(blocks):
            part = words.where(F.pmod(F.xxhash64("ord", "keyword"), F.lit(blocks)) == b) if blocks > 1 else words
            more.append(_by_distance(spark, open_, part, k, min_score))
    every = best.select(ROW, "key.ord", "key.keyword", "score")
    for m in more:
        every = every.unionByName(m)
    rank = Window.partitionBy(ROW).orderBy(F.desc("score"), "ord", "keyword")
    top = every.withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k)
    return rows.select(*ids, ROW).join(top, ROW).select(*ids, "rk", F.col("keyword").alias("value"), "score")


def fuzzy_query(clean: str | None, all_windows: bool = False) -> str:
    """The query of ``with_fuzzy_query`` of a cleaned text."""
    words = [w for w in (clean or "").split(" ") if w]
    n = len(words) - (2 if all_windows else 3)
    if n <= 0:
        return ""
    # every sign beyond ASCII becomes one space, as every other that is no letter or digit
    plain = "\n".join(words).lower().encode("ascii", "replace").translate(PLAIN).decode("ascii").split("\n")
    return " ".join([f"{x} {y} {z}" for x, y, z in zip(plain[:n], plain[1:], plain[2:])]).strip(" ")


PLAIN = bytes(c if c == 10 or chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _grouped(keys, values):
    """Values by key as arrays: the values, and where those of key 0, 1 ... begin and end."""
    import numpy as np

    keys = np.array(keys, np.int64)
    by = np.argsort(keys, kind="stable")
    ends = np.cumsum(np.bincount(keys)) if len(keys) else np.zeros(0, np.int64)
    return np.array(values, np.int32)[by], np.concatenate([[0], ends]).astype(np.int32)


class Matcher:
    """All keywords (ord, keyword, processed keyword) of a dictionary, sorted, for queries of
    which the k best are asked. Texts of some length hold k of the first keywords: automata
    of the first ones, in parts, settle these; what is left meets the others by hashes of
    spans (see ``Strings``), so that millions of keywords fit in a worker."""

    def __init__(self, block: list[tuple[int, str, str]], k: int):
        import numpy as np
        import pyarrow as pa

        self.k = k
        self.keywords, self.kps = (pa.array([x[c] for x in block], pa.large_string()) for c in (1, 2))
        number: dict[str, int] = {}                              # different ones in order
        of_row = [number.setdefault(x[2], len(number)) for x in block]
        self.same = _grouped(of_row, range(len(block)))
        different = list(number)
        self.first = [different[a:b] for a, b in zip((0, *EARLY), EARLY)]
        single, several = [], []
        for i, kp in enumerate(different[EARLY[-1]:], EARLY[-1]):
            (several if " " in kp else single).append((kp, i))
        self.words, self.phrases = (Strings([kp for kp, _ in x]) for x in (single, several))
        self.word_numbers, self.phrase_numbers = (np.array([i for _, i in x], np.int64) for x in (single, several))
        self.word_sizes = sorted({len(kp) for kp, _ in single})
        heads: dict[str, int] = {}
        sizes = sorted({(heads.setdefault(kp[:kp.index(" ")], len(heads)), len(kp)) for kp, _ in several})
        self.heads, self.sizes_of = Strings(list(heads)), _grouped([h for h, _ in sizes], [n for _, n in sizes])
        by_word: dict[str, list[int]] = {}
        for i, (_, _, kp) in enumerate(block):
            if " " in kp:
                for w in set(kp.split()):
                    rows = by_word.setdefault(w, [])
                    if len(rows) < k:
                        rows.append(i)
        self.shared = Strings(list(by_word))
        self.rows_of = _grouped([n for n, rows in enumerate(by_word.values()) for _ in rows], [i for rows in by_word.values() for i in rows])
        self.sizes = np.array([len(x[2]) for x in block], np.int32)
        self.reach, self.counts, self.order, self.automata, self.in_word = int(self.sizes.max(initial=0)), None, np.arange(len(block)), None, {}

    def _automata(self):
        import ahocorasick

        if self.automata is None:
            self.automata, n = [], 0
            for kps in self.first:
                if kps:
                    out = ahocorasick.Automaton()
                    for i, kp in enumerate(kps, n):
                        out.add_word(kp, i)
                    out.make_automaton()
                    self.automata.append(out)
                    n += len(kps)
        return self.automata

    def held(self, queries: list[str]) -> list[list[int]]:
        """The first k of the different keywords that each query holds."""
        out, left = [], []
        for i, q in enumerate(queries):
            found = set()
            for a in self._automata() if q else ():
                found.update([n for _, n in a.iter(q)])
                if len(found) >= self.k:
                    break
            out.append(found)
            if q and len(found) < self.k:
                left.append(i)
        if len(self.word_numbers) or len(self.phrase_numbers):
            lo = 0
            while lo < len(left):
                hi, size = lo + 1, len(queries[left[lo]])
                while hi < len(left) and size + len(queries[left[hi]]) < STRETCHES:
                    size, hi = size + len(queries[left[hi]]), hi + 1
                for i, found in zip(left[lo:hi], self._others([queries[i] for i in left[lo:hi]])):
                    out[i] |= found
                lo = hi
        return [heapq.nsmallest(self.k, x) for x in out]

    def _others(self, queries: list[str]) -> list[set[int]]:
        """Keywords behind the first ones that queries hold (of single words the first k)."""
        import numpy as np

        spans, bounds, starts, ends, of = self._words_in(queries)
        # phrases: the signs up to their first space end a word
        head = self.heads.find(spans, starts, ends)
        at = np.flatnonzero(head >= 0)
        sizes, begins = self.sizes_of
        counts = begins[head[at] + 1] - begins[head[at]]
        to = np.repeat(starts[at], counts) + sizes[_places(begins[head[at]], counts)]
        at = np.repeat(at, counts)
        fits = to <= bounds[of[at]]
        at, to = at[fits], to[fits]
        n = self.phrases.find(spans, starts[at], to)
        out: list[set[int]] = [set() for _ in queries]
        for i, x in zip(of[at[n >= 0]].tolist(), self.phrase_numbers[n[n >= 0]].tolist()):
            out[i].add(x)
        if self.word_sizes:
            words = [set(q.split()) for q in queries]
            new = list({w for x in words for w in x}.difference(self.in_word))
            if len(self.in_word) + len(new) > WORDS:
                self.in_word, new = {}, list({w for x in words for w in x})
            if new:
                spans, bounds, starts, ends, of = self._words_in(new)
                found: list[set[int]] = [set() for _ in new]
                for m in self.word_sizes:
                    at = np.flatnonzero(starts + m <= ends)
                    if not len(at):
                        break
                    n = self.words.find(spans, starts[at], starts[at] + m)
                    for i, x in zip(of[at[n >= 0]].tolist(), self.word_numbers[n[n >= 0]].tolist()):
                        found[i].add(x)
                self.in_word.update((w, heapq.nsmallest(self.k, x)) for w, x in zip(new, found))
            for x, some in zip(out, words):
                for w in some:
                    x.update(self.in_word[w])
        return out

    @staticmethod
    def _words_in(lines: list[str]):
        """Spans of lines behind each other, where each line ends, and of all places in words: the
        place, the end of its word, its line."""
        import numpy as np

        units = units_of("\n".join(lines))
        gap = np.append(units <= 32, True)
        starts, gaps = np.flatnonzero(~gap), np.flatnonzero(gap)
        bounds = np.cumsum([len(x) + 1 for x in lines]) - 1
        return Spans(units), bounds, starts, gaps[np.searchsorted(gaps, starts)], np.searchsorted(bounds, starts)

    def best(self, queries: list[str], min_score: int) -> list[list[tuple[int, int]]]:
        """The k best (index, score) of each query."""
        k = self.k
        if not len(self.kps) or k <= 0:
            return [[] for _ in queries]
        held = self.held(queries) if min_score < 60 else [[]] * len(queries)
        rows, begins = self.same
        out = []
        for q, numbers in zip(queries, held):
            # of keywords that are processed alike the first k were kept
            found = [(i, 60) for i in sorted(j for n in numbers for j in rows[begins[n]:begins[n + 1]].tolist())[:k]]
            if q and len(found) < k and min_score < 57:
                near = self._sharing(q) - {i for i, _ in found}
                found += [(i, 57) for i in sorted(near)[:k - len(found)]]
            if q and len(found) < k and min_score < 56 and (2 * min_score + 1) * len(q) <= 200 * self.reach:
                if self.counts is None:
                    self.counts = _letter_counts(self.kps.to_pylist())
                near = nearest(q, self.kps, self.sizes, self.counts, self.order, {i for i, _ in found}, k - len(found), min_score)
                found += [(i, s) for s, i in near]
            out.append(found)
        return out

    def _sharing(self, q: str) -> set[int]:
        """The first k keywords of several words with each word of a query."""
        import numpy as np

        units = units_of(q + " ")
        gap = units == 32
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        gaps = np.flatnonzero(gap)
        n = self.shared.find(Spans(units), starts, gaps[np.searchsorted(gaps, starts)])
        rows, begins = self.rows_of
        return {i for x in set(n[n >= 0].tolist()) for i in rows[begins[x]:begins[x + 1]].tolist()}


def _by_matcher(rows: DataFrame, words: DataFrame, ids, k: int, min_score: int, all_windows: bool) -> DataFrame:
    """(ids..., cleaned text) -> (ids..., rk, value, score) with a broadcast dictionary."""
    held = words.select("ord", "keyword", "kp").toArrow()
    block = sorted(zip(*(held.column(c).to_pylist() for c in ("ord", "keyword", "kp"))), key=lambda x: (x[0] is not None, x))
    shared = rows.sparkSession.sparkContext.broadcast(_as_data(Matcher(block, k)))
    n = len(ids)
    schema = T.StructType([*rows.select(*ids).schema.fields, T.StructField("rk", T.IntegerType()), T.StructField("value", T.StringType()),
                           T.StructField("score", T.IntegerType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        matcher = _from_data(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                best = matcher.best([fuzzy_query(t, all_windows) for t in part.column(n).to_pylist()], min_score)
                at = pa.array(np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for x in best]))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in part.columns[:n]), pa.array([r for x in best for r in range(1, len(x) + 1)], pa.int32()),
                     matcher.keywords.take(pa.array([i for x in best for i, _ in x], pa.int64())).cast(pa.string()),
                     pa.array([s for x in best for _, s in x], pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _by_distance(spark, queries: DataFrame, words: DataFrame, k: int, min_score: int) -> DataFrame:
    """The k best keywords of one block (at most some BLOCK, broadcast) for each query."""
    import numpy as np

    block = sorted((r["ord"], r["keyword"], r["kp"]) for r in words.select("ord", "keyword", "kp").collect())
    kps = [x[2] for x in block]
    data = (block, kps, np.array([len(w) for w in kps], np.int32), _letter_counts(kps))
    shared = spark.sparkContext.broadcast(data)

    def run(batches):
        import pyarrow as pa

        block, kps, sizes, counts = shared.value
        order, at = np.arange(len(block)), {}
        for i, (o, _, _) in enumerate(block):
            at.setdefault(o, []).append(i)
        for b in batches:
            out = []
            for row, q, have in zip(*(c.to_pylist() for c in b.columns)):
                skip = {i for o in have for i in at.get(o, [])}
                out += [(row, block[i][0], block[i][1], s) for s, i in nearest(q, kps, sizes, counts, order, skip, k, min_score)]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32()))],
                                             names=[ROW, "ord", "keyword", "score"])

    return queries.select(ROW, "q", "have").mapInArrow(run, f"{ROW} long, ord long, keyword string, score int")


def _ship_by_value():
    """Pickle this module's code into tasks, so executors need no install of the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
