"""Words and window hashes of whole Arrow text columns, computed on bytes with numpy.

All functions work on the UTF-8 bytes of a slice of a text column at once, so the cost
is a few array passes whatever the number of rows. Slices hold a few megabytes (one
text at least), which bounds the memory of a task by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
# for steps that hold a dozen arrays of eight bytes per byte of a slice, and whose rows do
# not become fewer in larger slices
SMALL_SLICE = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
# one random odd 64-bit number per byte value
_CODES = np.random.default_rng(20_240_611).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n + n // 4, SMALL_SLICE + 1)
        first = np.full(n, _BASE)
        first[0] = 1
        _powers = np.multiply.accumulate(first)
        first = np.full(n, _INVERSE)
        first[0] = 1
        _inverses = np.multiply.accumulate(first)
    return _powers[:n], _inverses[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of successive row ranges; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        a, b = bounds[start], bounds[stop]
        yield start, raw[a:b], bounds[start : stop + 1] - a
        start = stop


class Prefix:
    """Prefix sums of a polynomial hash over bytes: the hash of any span in O(1)."""

    def __init__(self, data: np.ndarray):
        powers, self.inverses = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scrambled hash of each span ``[start, end)``."""
        raw = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def letters(*separators: int | tuple[int, int]) -> np.ndarray:
    """A table of the bytes that belong to words: all but the separators."""
    table = np.ones(256, bool)
    for s in separators:
        low, high = s if isinstance(s, tuple) else (s, s)
        table[low : high + 1] = False
    return table


# words are runs of anything but ASCII white space
SPACED = letters(0x20, (0x09, 0x0D))
# words are runs of ASCII digits, a-z and all that is not ASCII
ALNUM = letters((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of each row (and the end)."""
    inside = table[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    firsts = offsets[:-1]
    firsts = firsts[firsts < len(data)]
    edge[firsts] |= inside[firsts]
    starts = np.flatnonzero(edge)
    # a word ends before a separator, at the end of its row or of the data
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    closing = offsets[1:] - 1
    closing = closing[closing >= 0]
    last[closing] |= inside[closing]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer, as Spark's bigint holds it."""
    return h.view(np.int64) if h.dtype == np.uint64 else h


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after the other."""
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(firsts, lengths)
