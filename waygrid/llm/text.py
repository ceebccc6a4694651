"""Arrow text columns as flat numpy arrays: words, hashes and per-document sums without a Python loop over words.

A word is a maximal run of characters other than space and \\x09-\\x0D. Those six are single bytes that never
occur inside a longer UTF-8 sequence, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values that look random."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLDEN)


_BYTES = keyed(256, 1)
_LOWERED = _BYTES.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; kept for runs of ordinary length, made anew for a longer text."""
    global _powers
    if len(_powers[0]) > n:
        return _powers
    made = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(max(n, RUN_BYTES) + 1, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= RUN_BYTES:
        _powers = tuple(made)
    return tuple(made)


class Texts:
    """A run of texts. ``start``/``end`` are the words' byte places; ``first[d]:first[d+1]`` are the words of text d."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.n = len(column)
        self.in_word = ~_SPACE[self.data]
        opens, closes = self._edges(self.in_word)
        self.start, self.end = opens, closes
        self.first = np.searchsorted(self.start, self.offsets)

    def _edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of True, none across two texts."""
        n = len(inside)
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        return np.flatnonzero(inside & (~before | cut[:n])), np.flatnonzero(inside & (~after | cut[1:])) + 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def count(self, of_bytes: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are marked."""
        total = np.concatenate([[0], np.cumsum(of_bytes, dtype=np.int64)])
        return np.diff(total[self.offsets])

    def hashes(self, start: np.ndarray, end: np.ndarray, lowered: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges that depend on their bytes alone; lowered takes A-Z as a-z."""
        n = len(self.data)
        powers, inverse = _powers_to(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWERED if lowered else _BYTES)[self.data] * powers[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _GOLDEN)

    def words(self, lowered: bool = False) -> np.ndarray:
        return self.hashes(self.start, self.end, lowered)

    def owner(self, first: np.ndarray) -> np.ndarray:
        """The text of each item, where text d has items first[d]:first[d+1]."""
        return np.repeat(np.arange(self.n), np.diff(first))


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of consecutive words that lie in one text, and each window's first word."""
    at = np.arange(max(0, len(words) - size + 1))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = at[owner[at] == owner[at + size - 1]] if len(at) else at
    out = np.zeros(len(at), np.uint64)
    for k, c in enumerate(keyed(size, 2)):
        out += words[at + k] * (c | np.uint64(1))
    return mix(out), at


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a column into ranges of rows that hold about ``most`` bytes of text each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) if len(column) else np.empty(0)
    total, begin = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            total, begin = 0, i
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)
