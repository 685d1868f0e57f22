"""Words of whole texts, cut out of Arrow string buffers with numpy, a bounded block of documents at a time.

Every word class used here is decided byte by byte: separators are ASCII and each byte of a longer UTF-8 sequence belongs
to a word. So the bytes of a block are classified at once and no text becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text a block holds at most, unless one document is longer; then that document is a block of its own.
BLOCK_BYTES = 2 << 20

_MULTIPLIER, _LENGTH = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _table(separators: list[tuple[int, int]], lower: bool) -> np.ndarray:
    """What each byte becomes: itself or its lower case, 0 for a separator."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    for first, last in separators:
        table[first:last + 1] = 0
    return table


#: [^\x20\x09-\x0D]+ ; byte 0 is a word byte there, so it is kept apart from the separator mark by ``_NUL``.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)], lower=False)
SPACED_LOWER = _table([(0x20, 0x20), (0x09, 0x0D)], lower=True)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased.
LETTERED = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], lower=True)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text begins and the last ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold at most ``limit`` bytes, or one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """The words of some documents, in order.

    ``data`` holds the mapped bytes of all words without separators; word i is ``data[at[i]:at[i + 1]]`` and began at
    byte ``start[i]`` of the block. Document d has the words ``of[d]`` to ``of[d + 1]``.
    """

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    of: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    def lengths(self) -> np.ndarray:
        return np.diff(self.at)

    def _terms(self) -> np.ndarray:
        """What each byte adds to its word's hash."""
        lengths = self.lengths()
        powers = np.full(int(lengths.max()), _MULTIPLIER, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        within = np.arange(len(self.data), dtype=np.int64) - np.repeat(self.at[:-1], lengths)
        return (self.data.astype(np.uint64) + 1) * powers[within]

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word: equal words have equal hashes."""
        if not self.n:
            return np.zeros(0, np.uint64)
        sums = np.add.reduceat(self._terms(), self.at[:-1])
        return mix(sums + self.lengths().astype(np.uint64) * _LENGTH)

    def stems(self, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size, the words longer than it and the hashes of their first bytes."""
        if not self.n:
            return
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(self._terms(), out=sums[1:])
        for size in sizes:
            long_ = np.flatnonzero(self.lengths() > size)
            begin = self.at[:-1][long_]
            yield size, long_, mix(sums[begin + size] - sums[begin] + np.array([size], np.uint64) * _LENGTH)

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends there."""
        lengths, order = self.lengths(), np.arange(self.n, dtype=np.int64)
        out = np.full(len(self.data) + self.n, 32, np.uint8)
        out[np.arange(len(self.data), dtype=np.int64) + np.repeat(order, lengths)] = self.data
        begin = self.at[:-1] + order
        return out.tobytes(), begin, begin + lengths


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (one to one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of the documents whose texts are ``data[offsets[d]:offsets[d + 1]]``."""
    base = offsets - offsets[0]
    mapped = table[data[offsets[0]:offsets[-1]]]
    inside = mapped != 0
    if table[0] == 0 and table is not LETTERED:  # byte 0 maps to itself and belongs to words there
        inside |= data[offsets[0]:offsets[-1]] == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = base[:-1][np.diff(base) > 0]
    begins[heads] = inside[heads]
    start = np.flatnonzero(begins)
    at = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside))
    return Words(mapped[inside], at, start, np.searchsorted(start, base))
