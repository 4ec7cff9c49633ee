"""Rolling hashes and winnowing over whole batches of texts, as NumPy array passes."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash modulo 2**64; odd, so that its powers have inverses.
BASE = 0x9E3779B97F4A7C15


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each text starts (with the end as last entry)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class Hasher:
    """Hashes of any window of one array of symbols, each in constant time."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        inverse = pow(BASE, -1, 1 << 64)
        terms = symbols.astype(np.uint64)
        terms += np.uint64(0x51ED27)
        terms *= _powers(BASE, n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.prefix[1:])
        self.inverse = _powers(inverse, n + 1)

    def rolling(self, k: int) -> np.ndarray:
        """The hash of each window of k symbols."""
        if len(self.prefix) <= k:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[:-k]) * self.inverse[: len(self.prefix) - k])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each window [start, end)."""
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least value of each window of w entries, by doubling."""
    out, have = a, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(h: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions of which the hash is the least of a window of w valid positions (all of those that tie).

    Every run of w valid positions in a row holds one at least, and which ones are chosen depends on
    the run's content only: equal runs choose equal positions.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    keyed = np.where(valid, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    least = sliding_min(keyed, w)
    whole = np.cumsum(np.concatenate(([0], ~valid)))
    inside = whole[w:] == whole[:-w]
    least = np.where(inside, least, np.uint64(0))
    # a position is chosen if some whole window that holds it has its hash as the least: the greatest of their minima is that hash
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    highest = ~sliding_min(~padded, w)
    return np.flatnonzero(valid & (highest[: len(h)] == h))
