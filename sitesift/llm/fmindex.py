"""A word-level FM-index in numpy: suffix array, wavelet-tree ranks, backward search
and locate by sampled suffix positions. One index covers one bounded shard of text."""

from __future__ import annotations

import numpy as np

SAMPLE = 8   # every SAMPLE-th suffix position of a run is stored


def suffix_array(seq: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes of ``seq`` (symbols 0..sigma-1). Symbol 0 separates runs and
    every separator is a symbol of its own, smallest first, so no comparison passes one.
    Prefix doubling; only suffixes that still tie are sorted again."""
    n = len(seq)
    seps = np.flatnonzero(seq == 0)
    end = np.append(seps, n)[np.searchsorted(seps, np.arange(n))]   # separator at or after i
    bits = max(1, int(sigma - 1).bit_length())
    depth = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    for j in range(depth):
        sym = np.zeros(n, np.int64)
        sym[:n - j] = seq[j:]
        inside &= (np.arange(n) + j) < end
        key = (key << bits) | np.where(inside, sym, 0)
    sa = np.argsort(key)
    sk = key[sa]
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = sk[1:] != sk[:-1]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    k = depth
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        s = sa[at]
        beyond = s + k
        key2 = np.where(beyond < end[s], rank[np.minimum(beyond, n - 1)] + n, 0)
        key2 = np.where(beyond >= end[s], s, key2)     # separator seen: its position decides
        order = np.lexsort((key2, start[at]))
        s, key2, group = s[order], key2[order], start[at]
        sa[at] = s
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = (group[1:] != group[:-1]) | (key2[1:] != key2[:-1])
        head[at] = new
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[s] = start[at]
        k *= 2


class Wavelet:
    """Wavelet matrix: one bit vector a level with counts every 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n = len(seq)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            packed = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            packed[:self.n] = bit
            w = np.packbits(packed, bitorder="little").view(np.uint64)
            self.words.append(w)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)[:-1]]))
            one = bit.astype(bool)
            self.zeros.append(self.n - int(one.sum()))
            cur = np.concatenate([cur[~one], cur[one]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        lo, hi = np.zeros(len(i), np.int64), i
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at position i and its occurrences before i."""
        symbol, lo, hi = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i
        for k in range(self.levels):
            one = (self.words[k][hi >> 6] >> (hi & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, b = self._ones(k, lo), self._ones(k, hi)
            symbol = symbol * 2 + one
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return symbol, hi - lo


class FMIndex:
    """Index of ``seq`` over symbols 0..sigma-1; 0 separates runs and never matches."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = seq.astype(np.int64)
        n = len(seq)
        sa = suffix_array(seq, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.bwt = Wavelet(seq[sa - 1], sigma)
        run_start = np.ones(n, bool)
        run_start[1:] = seq[:-1] == 0
        self.sampled = (sa % SAMPLE == 0) | run_start[sa]
        self.slot = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [lo, hi) of each row of ``phrases`` (symbols over 0), from its last
        word back; phrases without an occurrence get an empty range."""
        m = len(phrases)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.bwt.n, np.int64)
        live = np.arange(m)
        for c in phrases.T[::-1]:
            c = c[live]
            a = self.first[c] + self.bwt.rank(c, lo[live])
            b = self.first[c] + self.bwt.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        dead = np.ones(m, bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: last-to-first steps to the next sample."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = at[live]
            done = self.sampled[r]
            out[live[done]] = self.samples[self.slot[r[done]]] + steps[live[done]]
            live = live[~done]
            c, before = self.bwt.access_rank(at[live])
            at[live] = self.first[c] + before
            steps[live] += 1
        return out

    def occurrences(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase row, text position) of every occurrence."""
        lo, hi = self.search(phrases)
        count = hi - lo
        which = np.repeat(np.arange(len(phrases)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        return which, self.locate(rows)
