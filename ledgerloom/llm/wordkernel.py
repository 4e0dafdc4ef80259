"""Vectorised words over Arrow string buffers: boundaries and 64-bit hashes without a Python loop over words.

A word's hash is a polynomial over random byte values modulo 2**64, taken from prefix sums, then mixed; runs of
words are hashed the same way. Equal sequences always hash alike; two different ones collide with probability
of about 2**-60.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = (1 << 20) - 1024  # tables of powers then have 2**20 entries
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.empty(size, np.uint64)
            a[0] = 1
            a[1:] = np.uint64(b)
            out.append(np.multiply.accumulate(a))
        got = _powers[base] = (out[0], out[1])
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each pair, position independent."""
    p, inv = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    data: np.ndarray  # bytes of the chunk
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word; one more than rows


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most about limit bytes; a longer row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    trim()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trim() -> None:
    """Gives freed memory back to the system: workers live on between stages, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    _libc()(0)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes outside [\\x20\\x09-\\x0D] within each row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z.astype(np.uint64), np.zeros(len(offsets), np.int64))
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = solid[edge]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = solid[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    h = segment_hash((_BYTE_LOWER if lower else _BYTE)[data], starts, ends, _BASE)
    return Words(data, starts, ends, h, np.searchsorted(starts, offsets))


def runs(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word index) and hash of every run of k words inside one row."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.arange(n - k + 1)
    at = at[row[: n - k + 1] == row[k - 1 :]]
    return at, segment_hash(w.hash, at, at + k, _WORD_BASE)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
