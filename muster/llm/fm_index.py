"""FM-index of a sequence of symbols: suffix order, wavelet matrix with ranks, sampled suffix positions.

Symbols are small integers; 0 ends the sequence and stands nowhere else, so that each step back from a suffix is exact.
Patterns are searched backwards, many at once, and their occurrences are located by walking to the next sampled suffix.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order, by prefix doubling.

    Only suffixes that still tie with a neighbour are sorted again. Suffixes beyond the end count as smaller than all.
    """
    n = len(symbols)
    depth = max(1, 63 // (bits + 1))
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits + 1
        if k < n:
            key[:n - k] |= symbols[k:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    del key, sorted_key
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of each tied group
    rank = np.empty(n + 1, np.int64)
    rank[order] = heads + 1
    rank[n] = 0
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        at = order[places]
        key = rank[at] * (n + 1) + rank[np.minimum(at + depth, n)]
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[places] = at
        changed = np.empty(len(places), bool)
        changed[0] = True
        np.not_equal(key[1:], key[:-1], out=changed[1:])
        new[places] = changed
        rank[at] = places[np.maximum.accumulate(np.where(changed, np.arange(len(places)), 0))] + 1
        depth *= 2


class BitRanks:
    """A bit vector that counts the ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(np.count_nonzero(bits))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of any symbol before any place, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[BitRanks] = []
        self.zeros: list[int] = []
        self.bits = bits
        for level in range(bits - 1, -1, -1):
            ones = ((symbols >> level) & 1).astype(bool)
            self.levels.append(BitRanks(ones))
            self.zeros.append(len(symbols) - self.levels[-1].ones)
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low, high = np.zeros_like(at), at
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = level.rank(low), level.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def rank_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before that place."""
        low, high, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level.get(high).astype(bool)
            symbol = symbol * 2 + one
            a, b = level.rank(low), level.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return symbol, high - low


class FMIndex:
    """Counts and locates patterns in ``symbols``, whose last entry alone is 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 16):
        self.n = len(symbols)
        bits = max(1, int(alphabet - 1).bit_length())
        order = suffix_order(symbols, bits)
        last = symbols[order - 1]  # the symbol before each suffix; before the first one stands the last
        self.ranks = WaveletMatrix(last.astype(np.int32), bits)
        counts = np.bincount(symbols, minlength=alphabet)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        sampled = order % sample == 0
        self.sampled = BitRanks(sampled)
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of patterns, each a row aligned to the right."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - step]
            base = self.first[symbol]
            low[live], high[live] = base + self.ranks.rank(symbol, low[live]), base + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping back to the nearest sampled one."""
        at, steps, found = places.copy(), 0, np.empty(len(places), np.int64)
        open_ = np.arange(len(places))
        while len(open_):
            hit = self.sampled.get(at).astype(bool)
            found[open_[hit]] = self.samples[self.sampled.rank(at[hit])] + steps
            open_, at = open_[~hit], at[~hit]
            if len(open_):
                symbol, before = self.ranks.rank_at(at)
                at = self.first[symbol] + before
                steps += 1
        return found
