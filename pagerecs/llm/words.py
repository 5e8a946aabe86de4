"""Vectorised words and five-word shingles of UTF-8 texts.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, with A-Z
lower-cased; a word or shingle is known by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Bytes of a term: letters (after lower-casing) and every byte of a character beyond ASCII.
IS_LETTER = (_BYTES >= 128) | ((_BYTES >= 97) & (_BYTES <= 122))
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.ones((2, 1), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mixed(_BYTES.astype(np.uint64))


def powers(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    global _powers
    if _powers.shape[1] < n:
        each = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64).repeat(n + n // 4 + 8, 1)
        each[:, 0] = 1
        _powers = np.cumprod(each, axis=1, dtype=np.uint64)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, in order; ``offsets`` cut the bytes into rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = LOWERED[data]
    inside = ~IS_SPACE[low]
    edge = np.zeros(len(data) + 1, bool)  # a row begins here
    edge[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[low] * power[: len(data)], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * inverse[starts])
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


class Terms:
    """The terms of a run of rows: runs of letters, A-Z lower-cased."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWERED[data]
        inside = np.r_[False, IS_LETTER[self.low], False]
        edge = np.zeros(len(data) + 1, bool)  # a row begins here
        edge[offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        power, self._inverse = powers(len(data))
        self._total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[self.low] * power[: len(data)], out=self._total[1:])

    def hashes(self, chosen: np.ndarray, ends: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
        """Of the chosen terms' bytes before ``ends``."""
        starts = self.starts[chosen]
        value = (self._total[ends] - self._total[starts]) * self._inverse[starts]
        return mixed(value + np.asarray(seed, np.uint64))

    def texts(self, chosen: np.ndarray) -> pa.Array:
        size = self.ends[chosen] - self.starts[chosen]
        offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
        data = self.low[np.repeat(self.starts[chosen] - offsets[:-1], size) + np.arange(offsets[-1])]
        array = pa.LargeStringArray.from_buffers(len(chosen), pa.py_buffer(offsets), pa.py_buffer(data))
        return array.cast(pa.string())


def shingles(rows: np.ndarray, hashes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words of a row; a row with fewer
    words (but one at least) has its whole sequence as one."""
    power = powers(width + 1)[0]
    n = len(rows)
    if not n:
        return rows, hashes
    full = np.flatnonzero(rows[width - 1 :] == rows[: n - width + 1]) if n >= width else np.zeros(0, np.int64)
    value = np.zeros(len(full), np.uint64)
    for k in range(width):
        value += hashes[full + k] * power[k]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    short = np.flatnonzero(count < width)
    short_value = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        short_value[has] += hashes[first[short[has]] + k] * power[k]
    short_value += count[short].astype(np.uint64) * power[width]
    all_rows = np.r_[rows[full], rows[first[short]]]
    values = mixed(np.r_[value + np.uint64(width) * power[width], short_value])
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], values[order]
