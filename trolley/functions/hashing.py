"""Keyed randomness: a draw depends on its key alone, never on the partitioning."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(seed: int, *keys: Column | str) -> Column:
    """Hex md5 of ``seed|key|key...``; sorting by it is a random order."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_to_long(digest: Column, digits: int = 15) -> Column:
    """The first hex digits of a digest as a non-negative bigint (60 bits at most)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


# md5's constants: sines, shifts and the word each step reads
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ONE_BLOCK = 55


def _md5_heads(words: list, shape: tuple[int, int]) -> np.ndarray:
    """The first 8 digest bytes of one-block messages as big-endian numbers.

    Each of the 16 ``words`` is a number or an array that broadcasts to ``shape``.
    """
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[_WORDS[i]]
        f += a
        f += np.uint32((word + _SINES[i]) % 2**32) if isinstance(word, int) else word + np.uint32(_SINES[i])
        np.left_shift(f, _SHIFTS[i], out=turned)
        np.right_shift(f, 32 - _SHIFTS[i], out=f)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = ((x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in ((a, _START[0]), (b, _START[1])))
    return (first << np.uint64(32)) | second


def numbered_longs(prefixes: np.ndarray, start: int, count: int) -> np.ndarray:
    """``hash_to_long`` of the md5 of each prefix followed by each number from ``start`` on.

    ``prefixes`` are rows of equally many bytes; the result has a row per prefix and a
    column per number. Messages of one md5 block are hashed all at once, longer ones
    one by one.
    """
    n, length = prefixes.shape
    digits = [str(k).encode() for k in range(start, start + count)]
    if length + len(digits[-1]) > _ONE_BLOCK:
        texts = [row.tobytes() for row in prefixes]
        heads = [[int.from_bytes(hashlib.md5(t + k).digest()[:8], "big") for k in digits] for t in texts]
        return (np.array(heads, np.uint64).reshape(n, count) >> np.uint64(4)).astype(np.int64)
    full, rest = divmod(length, 4)
    tail = np.zeros((count, 64), np.uint8)
    for row, k in zip(tail, digits, strict=True):
        row[rest : rest + len(k)] = np.frombuffer(k, np.uint8)
        row[rest + len(k)] = 0x80
    ends = tail.view("<u4")
    starts = np.zeros((n, 4 * (full + 1)), np.uint8)
    starts[:, :length] = prefixes
    begun = starts.view("<u4")
    words: list = [0] * 16
    for i in range(full):
        words[i] = begun[:, i : i + 1]
    words[full] = begun[:, full : full + 1] | ends[None, :, 0]
    for i in range(1, 14 - full):
        if ends[:, i].any():
            words[full + i] = ends[None, :, i]
    words[14] = np.array([[8 * (length + len(k)) for k in digits]], np.uint32)
    return (_md5_heads(words, (n, count)) >> np.uint64(4)).astype(np.int64)
