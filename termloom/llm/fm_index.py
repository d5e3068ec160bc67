"""A compressed FM-index over letters: wavelet matrix with packed bits and popcount ranks, searched for many patterns at once.

Suffixes are ordered by their first ``depth`` letters only (a k-BWT): backward search is exact for patterns up to that length, and
the order costs one sort per doubling of the compared length instead of one for the longest repeat of the text.
"""

from __future__ import annotations

import numpy as np

_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with rank: 64-bit words and the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        words[:len(packed)] = packed
        self.words = words.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & _BELOW[i & 63])


class WaveletMatrix:
    """Ranks of each symbol in a sequence over 0 .. sigma-1: one bit vector per binary digit, most significant first."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[tuple[np.ndarray, Bits, int]] = []
        symbols = np.arange(sigma)
        self.start = np.zeros(sigma, np.int32)  # where each symbol's run begins below the last level
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            one = (seq >> bit & 1).astype(bool)
            bits, zeros = Bits(one), int(len(seq) - one.sum())
            high = (symbols >> bit & 1).astype(bool)
            self.levels.append((high, bits, zeros))
            seq = np.concatenate([seq[~one], seq[one]])
            r = bits.rank(self.start)
            self.start = np.where(high, zeros + r, self.start - r).astype(np.int32)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position i, for arrays of both."""
        for high, bits, zeros in self.levels:
            r = bits.rank(i)
            i = np.where(high[symbol], zeros + r, i - r)
        return i - self.start[symbol]


def suffix_order(seq: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """All suffixes ordered by their first ``depth`` symbols or more: several symbols in one number at first, then doubling."""
    n, bits = len(seq), max(1, int(sigma).bit_length())
    k = max(1, min(62 // bits, depth))
    key = np.zeros(n, np.int64)
    for j in range(k):  # behind the end stands 0
        key <<= bits
        key[:max(0, n - j)] |= seq[j:]
    while True:
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        np.cumsum(np.diff(key[order]) != 0, out=new[1:])
        if k >= depth or n == 0 or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        if k < n:
            key[:n - k] += rank[k:] + 1
        k *= 2


class FMIndex:
    """Index of one sequence of symbols 0 .. sigma-1 for patterns of up to ``depth`` symbols, none of them 0.

    0 separates texts; one is appended as the end.
    """

    def __init__(self, seq: np.ndarray, sigma: int, depth: int):
        text = np.append(seq, 0).astype(np.int64)
        self.sa = suffix_order(text, sigma, depth).astype(np.int32)
        counts = np.bincount(text, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.letters = text[self.sa - 1].astype(np.int32)  # the Burrows-Wheeler transform
        self.bwt = WaveletMatrix(self.letters, sigma)
        self._base = self.first[:-1]

    def symbol(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array interval of each one-symbol pattern."""
        return self.first[s], self.first[s + 1]

    def extend(self, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward-search step: intervals of the patterns with symbol ``s`` put before them."""
        both = np.concatenate([s, s])
        at = self._base[both] + self.bwt.rank(both, np.concatenate([lo, hi]))
        return at[:len(s)], at[len(s):]
