"""Vectorised word and window hashing of Arrow text columns (numpy).

Words are the maximal runs ``[^\\x20\\x09-\\x0D]+``.  Hashes are 64-bit: every
byte is mapped to a fixed random value, a prefix sum of value * B^position
(mod 2^64) gives the hash of any byte range with one subtraction, and windows
of words roll the same way over the word hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUES = mix(np.arange(1, 257, dtype=U))
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, U), np.full(size, _INV, U)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers[0][:n], _powers[1][:n]


class RangeHash:
    """Hashes of ranges of a byte (or word-hash) sequence."""

    def __init__(self, values: np.ndarray):
        up, self._down = powers(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(U))


class Words:
    """Words of a slice of texts: byte ranges, owning text, 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool = False):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        if len(data) > 1:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        at = offsets[:-1][full]
        first[at] = inside[at]
        at = offsets[1:][full] - 1
        last[at] = inside[at]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.bytes = RangeHash((_FOLDED if fold_case else _VALUES)[data])
        self.hash = self.bytes(self.start, self.end)
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``n`` words inside one text."""
        if len(self.start) < n:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return at, RangeHash(self.hash)(at, at + n)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, offsets)`` of runs of rows whose texts hold about
    ``limit`` bytes (one longer text makes a run of its own); null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    give_back()


def give_back() -> None:
    """Returns a worker's freed memory to the system; it may idle while the
    executor's JVM works on a join of its output."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not on this platform
        pass


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text's byte range."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over ``key``: values found twice or more, and those equal to an earlier one."""
    again = np.zeros(len(key), bool)
    both = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again[order[1:][same]] = True
        both[order[1:][same]] = True
        both[order[:-1][same]] = True
    return both, again
