"""Word and shingle hashing over Arrow string columns, vectorised across the texts of a batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z hash as a-z
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(max(n, 1), base, np.uint64), dtype=np.uint64)]


class _Powers:
    """Powers of the hash base and of its inverse; grown for a text longer than a chunk."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n, self.up, self.down = n, _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def release() -> None:
    """Hand freed memory back to the system, as workers stay for the next tasks. Only allocators that can are asked."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) of adjoining texts, and where each text's words begin."""
    n = len(data)
    up, down = _POWERS.get(max(n, CHUNK))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return mixed((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For every text, the sorted distinct hashes of its 5-word shingles; with fewer words one hash of them all; without any, none."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        own = offsets[lo : hi + 1]
        w, first = word_hashes(data[own[0] : own[-1]], own - own[0])
        m = max(len(w) - 4, 0)
        s = w[:m] * _MULTIPLIERS[0]
        for k in range(1, SHINGLE):
            s = s + w[k : m + k] * _MULTIPLIERS[k]
        s = mixed(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                x = np.sort(s[a : b - 4])
                yield x[np.r_[True, x[1:] != x[:-1]]]
            elif b > a:
                yield mixed(np.array([(w[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.empty(0, np.uint64)
