"""Vectorised words and word windows of many texts at once (NumPy over the bytes of an Arrow column).

A word is a maximal run of bytes other than space and 0x09-0x0D; UTF-8 keeps those bytes out of other characters.
A word's hash is a polynomial over its bytes modulo 2**64, finished by a mixer; equal words have equal hashes
in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of ``n`` texts in reading order."""

    n: int
    hashes: np.ndarray  # uint64, one for each word
    first: np.ndarray  # index of each text's first word, n + 1 entries

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word's index of each window of k words inside one text."""
        h = self.hashes
        m = len(h) - k + 1
        if m <= 0:
            return np.empty(0, U64), np.empty(0, np.int64)
        docs = self.docs
        inside = np.flatnonzero(docs[:m] == docs[k - 1 :])
        return window_hash([h[inside + j] for j in range(k)]), inside


def window_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of sequences given column by column; the order of columns counts."""
    total = np.zeros(len(columns[0]), U64)
    for j, c in enumerate(columns):
        total += mix(c + U64((0xD6E8FEB86659FD93 * (j + 1)) & (2**64 - 1)))
        total *= U64(0xC2B2AE3D27D4EB4F)
    return mix(total + U64(len(columns)))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    a = pc.fill_null(column, "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    width = np.int64 if pa.types.is_large_string(a.type) else np.int32
    offsets = np.frombuffer(a.buffers()[1], width)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(a) else np.empty(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, piece: int = 4 << 20) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i+1]]``; hashing takes about ``piece`` bytes at once."""
    n = len(offsets) - 1
    word = ~_IS_SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = word[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = word[1:]
        inner = offsets[1:] - 1
        after[inner[inner >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    hashes = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        power, inverse = _power_tables(hi - lo)
        part = data[lo:hi]
        values = _BYTE_VALUES[_LOWER[part] if lower else part] * power[: hi - lo]
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(values, out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        hashes[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return Words(n, mix(hashes), np.searchsorted(starts, offsets))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each text's span."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
