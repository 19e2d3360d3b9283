"""String similarity that native functions don't have, in Arrow batches: the exact 2*M/T
ratio of matching blocks (X8) and the full title score with partial and token forms (X7)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["ratio_udf", "title_score_udf", "matched", "ratio_2mt", "partial_distance", "title_score"]


# ---- matching blocks -------------------------------------------------------------------

def _longest_common(a: str, b: str) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest common substring; among the longest
    the first in ``a``, then the first in ``b``. By a suffix automaton of ``b``: linear in
    both lengths."""
    nexts: list[dict[str, int]] = [{}]
    link, size, first = [-1], [0], [0]              # first: where the state's strings first end in b
    last = 0
    for pos, c in enumerate(b, 1):
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(pos)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    best, state, n = (0, 0, 0), 0, 0
    for i, c in enumerate(a, 1):
        while state and c not in nexts[state]:
            state = link[state]
            n = size[state]
        if c in nexts[state]:
            state, n = nexts[state][c], n + 1
        else:
            n = 0
        if n > best[0]:
            # all strings of a state end at the same places
            best = (n, i - n, first[state] - n)
    return best


def matched(a: str, b: str) -> int:
    """Signs in matching blocks: the longest common substring, then the same left and right
    of it. Each step is linear in what it looks at."""
    total, work = 0, [(a, b)]
    while work:
        x, y = work.pop()
        if not x or not y:
            continue
        if x == y:
            total += len(x)
            continue
        n, i, j = _longest_common(x, y)
        if n:
            total += n
            work += [(x[:i], y[:j]), (x[i + n:], y[j + n:])]
    return total


def ratio_2mt(a: str, b: str) -> int:
    """round(100 * 2M / T) of the lower-cased strings; two empty ones are equal."""
    a, b = a.lower(), b.lower()
    return int(round(100 * (2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0)))


# ---- the full title score --------------------------------------------------------------

def _columns(pattern: str, text: str, top_row: int):
    """Distance of the whole pattern at each place of a text, bit-parallel: to the text up
    to there (``top_row`` 1) or to the best substring that ends there (0)."""
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score = full, 0, len(pattern)
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(xh | up) & full, up & xh
        score += bool(right & top) - bool(left & top)
        right = (right << 1 | top_row) & full
        up, down = (left << 1 | ~(xv | right)) & full, right & xv
        yield score


def partial_distance(pattern: str, text: str) -> int:
    """Smallest edit distance of ``pattern`` to any substring of ``text``."""
    if not pattern:
        return 0
    return min((*_columns(pattern, text, 0), len(pattern)))


def _ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    *_, d = _columns(a, b, 1)
    return 100.0 * (1.0 - d / max(len(a), len(b)))


def _partial(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    return 100.0 * (1.0 - partial_distance(short, long) / len(short)) if short else 0.0


def _tokens(a: str, b: str, score) -> float:
    """Best of the sorted tokens and of the shared tokens with and without the others."""
    x, y = a.split(), b.split()
    best = score(" ".join(sorted(x)), " ".join(sorted(y)))
    both = " ".join(sorted(set(x) & set(y)))
    with_x = " ".join(filter(None, [both, *sorted(set(x) - set(y))]))
    with_y = " ".join(filter(None, [both, *sorted(set(y) - set(x))]))
    return max(best, score(both, with_x), score(both, with_y), score(with_x, with_y))


def title_score(a: str, b: str) -> int:
    """0 to 100: the best of the plain ratio, and of token forms (x 0.95); where one side is
    1.5 times as long or more, of partial forms (x 0.9, beyond 8 times x 0.6, token forms
    x 0.95 more). Sides are lower-cased, other signs than a-z and 0-9 become spaces; an empty
    side scores 0. Ratios are by edit distance."""
    a, b = (re.sub("[^a-z0-9]", " ", s.lower()).strip() for s in (a, b))
    if not a or not b:
        return 0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return int(max(_ratio(a, b), 0.95 * _tokens(a, b, _ratio)) + 0.5)
    scale = 0.9 if longer <= 8 else 0.6
    return int(max(_ratio(a, b), scale * _partial(a, b), 0.95 * scale * _tokens(a, b, _partial)) + 0.5)


# ---- on Spark --------------------------------------------------------------------------

def _ship_by_value():
    """Pickle this module's code into tasks, so executors need no install of the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


def _once(a: pd.Series, b: pd.Series, score) -> pd.Series:
    """Equal pairs of a batch are compared once; a null side gives null."""
    pairs = [(None if x is None or x != x else x, None if y is None or y != y else y) for x, y in zip(a, b)]
    known = {p: None if None in p else score(*p) for p in set(pairs)}
    return pd.Series([known[p] for p in pairs], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact 2*M/T similarity (``ratio_2mt``)."""
    return _once(a, b, ratio_2mt)


@F.pandas_udf(T.IntegerType())
def title_score_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The full title score (``title_score``)."""
    return _once(a, b, title_score)
