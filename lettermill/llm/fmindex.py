"""A compressed full-text index: Burrows-Wheeler transform in a wavelet matrix of packed bits.

Every operation works on arrays of positions, one entry for each of many searches at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols at least by prefix doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    width = max(1, int(rank.max(initial=0)).bit_length())
    have = 1
    while have * 2 * width <= 63 and have < depth:  # several symbols packed into one word
        shifted = np.zeros(n, np.int64)
        shifted[: n - have] = rank[have:] if n > have else 0
        rank = (rank << (have * width)) | shifted
        have *= 2
    while True:
        order = np.argsort(rank)
        in_order = rank[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate(([0], in_order[1:] != in_order[:-1]))) if n else 0
        if have >= depth or not n or fresh[order[-1]] == n - 1:
            return order
        shifted = np.zeros(n, np.int64)
        shifted[: n - have] = fresh[have:] + 1
        rank = fresh * (n + 1) + shifted
        have *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Backward search over a sequence of symbols 1..sigma-1; 0 separates texts and matches nothing.

    depth is the number of symbols by which suffixes are in order; no search may be longer.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int):
        self.n, self.depth = len(symbols), depth
        self.sa = suffix_array(symbols, depth)
        bwt = symbols[self.sa - 1]
        counts = np.bincount(symbols, minlength=sigma)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.width = max(1, (sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        row = bwt
        start = np.zeros(sigma, np.int64)
        every = np.arange(sigma)
        for level in range(self.width - 1, -1, -1):
            bit = (row >> level) & 1
            bits = Bits(bit)
            zeros = int(len(row) - bit.sum())
            self.levels.append(bits)
            self.zeros.append(zeros)
            ones = bits.rank(start)
            start = np.where((every >> level) & 1, zeros + ones, start - ones)
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.start = start

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i entries of the transform."""
        for k, level in enumerate(range(self.width - 1, -1, -1)):
            ones = self.levels[k].rank(i)
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i - self.start[symbol]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the symbol and go on as those of [lo, hi)."""
        both = self.occurrences(np.concatenate((symbol, symbol)), np.concatenate((lo, hi))) + np.tile(self.first[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def arrays(self) -> dict[str, np.ndarray]:
        """All that searches need, as plain arrays."""
        return {
            "sizes": np.array([self.n, self.depth, self.width], np.int64),
            "first": self.first,
            "zeros": np.array(self.zeros, np.int64),
            "start": self.start,
            "words": np.stack([b.words for b in self.levels]),
            "before": np.stack([b.before for b in self.levels]),
        }

    @classmethod
    def of(cls, arrays) -> FMIndex:
        """An index from such arrays."""
        index = cls.__new__(cls)
        index.n, index.depth, index.width = (int(x) for x in arrays["sizes"])
        index.first, index.zeros, index.start, index.sa = arrays["first"], arrays["zeros"].tolist(), arrays["start"], None
        index.levels = []
        for words, before in zip(arrays["words"], arrays["before"], strict=True):
            bits = Bits.__new__(Bits)
            bits.words, bits.before = words, before
            index.levels.append(bits)
        return index


def backward(index: FMIndex, query: np.ndarray, end: np.ndarray, floor: np.ndarray, accept: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, lo, hi) of the longest match of the index that ends before each place and starts at floor at the earliest.

    accept(searches, lo, hi) says which intervals count as matches; what it refuses it must refuse for every longer match.
    """
    lo, hi, at = np.zeros(len(end), np.int64), np.full(len(end), index.n, np.int64), end.copy()
    live = np.flatnonzero(at > floor)
    while len(live):
        c = query[at[live] - 1]
        a, b = index.step(c, lo[live], hi[live])
        good = (c > 0) & (a < b)
        if accept is not None:
            some = np.flatnonzero(good)
            good[some] = accept(live[some], a[some], b[some])
        live, a, b = live[good], a[good], b[good]
        lo[live], hi[live] = a, b
        at[live] -= 1
        live = live[at[live] > floor[live]]
    return at, lo, hi


def maximal_matches(index: FMIndex, query: np.ndarray, starts: np.ndarray, least: int, accept: Callable | None = None, first: bool = False) -> tuple[np.ndarray, ...]:
    """Rows (lane, start, end, lo, hi): the matches of at least `least` symbols of each text of a query that can be longer on neither side.

    texts are query[starts[k]:starts[k + 1]]. Matching statistics are taken from right ends: if the longest match that
    ends in e starts in s and is too short, no long enough one ends before s + least. Of a long enough one the right end
    is first sought at the text's end and then by halving; the next match ends behind it. accept(lanes, lo, hi) as in
    backward(). With first a text is left at its first match, as it stands, which may go on to the right.
    """
    lanes = np.flatnonzero(np.diff(starts) >= least)
    bottom, top = starts[:-1], starts[1:]
    end = bottom + least
    begin = np.full(len(bottom), -1)  # start of the match whose right end is being sought; -1: none
    low, high = np.zeros(len(bottom), np.int64), np.zeros(len(bottom), np.int64)
    best_lo, best_hi = np.zeros(len(bottom), np.int64), np.zeros(len(bottom), np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    while len(lanes):
        sought = begin[lanes] >= 0
        floor = np.where(sought, begin[lanes], bottom[lanes])
        wrap = None if accept is None else (lambda k, a, b, lanes=lanes: accept(lanes[k], a, b))
        at, lo, hi = backward(index, query, end[lanes], floor, wrap)
        hit = np.where(sought, at == floor, end[lanes] - at >= least)
        mine, e = lanes[hit], end[lanes[hit]]
        best_lo[mine], best_hi[mine], low[mine] = lo[hit], hi[hit], e
        fresh = mine[~sought[hit]]
        begin[fresh], high[fresh] = at[hit][~sought[hit]], top[fresh] + 1
        if first:
            out.append((fresh, begin[fresh], low[fresh], best_lo[fresh], best_hi[fresh]))
            end[lanes[~hit]] = at[~hit] + least
            lanes = lanes[~hit]
            lanes = lanes[end[lanes] <= top[lanes]]
            continue
        # a miss behind a match bounds its right end; any other one leads on to the next end that can be long enough
        bound = lanes[~hit & sought]
        high[bound] = end[bound]
        lost = ~hit & ~sought
        end[lanes[lost]] = at[lost] + least
        active = lanes[hit | sought]
        whole = active[high[active] - low[active] == 1]
        out.append((whole, begin[whole], low[whole], best_lo[whole], best_hi[whole]))
        begin[whole], end[whole] = -1, low[whole] + 1
        more = active[high[active] - low[active] > 1]
        end[more] = np.where(high[more] > top[more], top[more], (low[more] + high[more]) // 2)
        lanes = lanes[end[lanes] <= top[lanes]]
    found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((found[1], found[0]))
    return tuple(x[order] for x in found)
