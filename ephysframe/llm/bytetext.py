"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

A word is a maximal run of ASCII letters (A-Z counted as a-z), digits and
non-ASCII characters; every byte of a non-ASCII character is 0x80 or more, so
bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

#: Text bytes handled at once, few enough for the arrays to stay in a core's cache; a longer text is handled alone.
SLICE = 1 << 17
#: Odd multipliers of the hashes modulo 2**64.
P = np.uint64(0x9E3779B97F4A7C15 | 1)
Q = np.uint64(0xD6E8FEB86659FD93)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((P, P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of at most SLICE bytes (or one row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        end = min(end, n)
        yield first, end, body[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


class Words:
    """Words of a slice: byte ``start`` and ``end``, ``row`` and 64-bit ``code`` of each, and the rows' ``first`` word."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        n, rows = len(body), len(offsets) - 1
        self.lower = LOWER[body]
        inside = IS_WORD[self.lower]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:n]
        ends[:-1] &= ~inside[1:] | cut[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.code = mixed((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64) * Q)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(index of the first word, hash)`` of every run of k words of one row."""
        n = len(self.code) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.flatnonzero(self.row[:n] == self.row[k - 1:k - 1 + n])
        value = np.zeros(n, np.uint64)
        for j in range(k):
            value = value * Q + self.code[j:j + n]
        return whole, mixed(value[whole] + np.uint64(k))

    def text(self, first: int, count: int) -> str:
        """Words joined by one space."""
        return b" ".join(self.lower[self.start[i]:self.end[i]].tobytes() for i in range(first, first + count)).decode("utf-8", "replace")
