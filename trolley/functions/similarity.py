"""String similarity metrics and the rule for which products may share a family."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Metric(NamedTuple):
    """``prepare`` runs once per row, ``score`` (0..100) once per compared pair.

    ``at_most`` is a cheap upper bound of the score from the sizes of the two sides.
    ``band``, where a metric has one, gives the same scores for each row of an array and
    the rows after it: ``(first, scores)`` with a line for each row from ``first`` on and a
    column for each row from ``first`` on.
    """

    prepare: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]
    at_most: Callable[[Column, Column], Column]
    band: Callable[[pa.Array, int], Iterator[tuple[int, np.ndarray]]] | None = None


def _word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda w: w != ""))


def _jaccard_score(a: Column, b: Column) -> Column:
    """Share of common words x100, truncated; 0 when neither side has a word."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.coalesce(F.floor(F.try_divide(common, union) * F.lit(100)), F.lit(0)).cast("int")


def _jaccard_bound(a: Column, b: Column) -> Column:
    """No more words can be common than the smaller side has."""
    return F.coalesce(
        F.try_divide(F.least(F.size(a), F.size(b)) * 100, F.greatest(F.size(a), F.size(b))), F.lit(0.0)
    )


BAND_ROWS = 100  # rows at least that are compared with those after them at a time
_BAND_WORDS = 4096  # words at a time, so that the table of rows and words stays small


def _jaccard_band(sets: pa.Array, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """``_jaccard_score`` of each row with the ``window`` rows after it, counted by tables of rows and words."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = sets.flatten().dictionary_encode().indices.to_numpy()
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    step = max(window, BAND_ROWS)
    for first in range(0, len(sizes), step):
        last = min(first + step, len(sizes))
        end = min(last + window, len(sizes))
        own = slice(cuts[first], cuts[end])
        _, place, times = np.unique(codes[own], return_inverse=True, return_counts=True)
        # a word that no other row has is common to no pair
        met = times > 1
        column, row = (np.cumsum(met) - 1)[place], rows[own] - first
        column, row = column[met[place]], row[met[place]]
        common = np.zeros((last - first, end - first))
        for low in range(0, int(met.sum()), _BAND_WORDS):
            some = (column >= low) & (column < low + _BAND_WORDS)
            table = np.zeros((end - first, min(_BAND_WORDS, int(met.sum()) - low)), np.float32)
            table[row[some], column[some] - low] = 1
            common += table[: last - first] @ table.T
        union = sizes[first:last, None] + sizes[None, first:end] - common
        yield first, np.where(union > 0, np.floor(common / np.maximum(union, 1) * 100), 0).astype(np.int32)


def _indel_bound(a: Column, b: Column) -> Column:
    """The subsequence is no longer than the shorter text; half a point for rounding."""
    shared = F.least(F.length(a), F.length(b)) * 200
    return F.coalesce(F.try_divide(shared, F.length(a) + F.length(b)) + 0.5, F.lit(100.0))


LANE_WORDS = 8  # texts of more than 8 x 64 characters on both sides are compared one by one
_TABLE_BYTES = 16 << 20


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & where.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _padded(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row of codes per text, filled up with 0."""
    at = np.arange(int(lengths.max(initial=0)))
    inside = at < lengths[:, None]
    return np.where(inside, codes[np.where(inside, starts[:, None] + at, 0)], 0)


def _lane_lengths(a: np.ndarray, b: np.ndarray, kinds: int) -> np.ndarray:
    """Longest common subsequences of many pairs at once, one lane of 64-bit words per pair.

    Rows of ``a`` and ``b`` hold codes from 1 to ``kinds``; 0 fills them up and meets nothing.
    """
    lanes, width = a.shape
    words = max(-(-width // 64), 1)
    where = np.zeros((words, kinds + 1, lanes), np.uint64)
    lane = np.arange(lanes)
    for i in range(width):
        where[i // 64, a[:, i], lane] |= np.uint64(1 << (i % 64))
    where[:, 0] = 0
    free = np.full((words, lanes), ~np.uint64(0))
    for code in b.T:
        carry = np.zeros(lanes, np.uint64)
        for w in range(words):
            hit = free[w] & where[w, code, lane]
            once = free[w] + hit
            total = once + carry
            carry = ((once < hit) | (total < once)).astype(np.uint64)
            free[w] = total | (free[w] - hit)
    # bits past the end of a text are never hit, so they stay set
    return words * 64 - np.bitwise_count(free).sum(axis=0, dtype=np.int64)


def _subsequence_lengths(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequence and summed length, in code points, of each pair."""
    first, second = left.tolist(), right.tolist()
    codes = np.frombuffer("".join(first + second).encode("utf-32-le"), np.uint32) + 1  # 0 fills up
    lengths = np.fromiter(map(len, first + second), np.int64, 2 * len(first))
    starts = np.cumsum(lengths) - lengths
    n = len(first)
    len_a, len_b = lengths[:n], lengths[n:]
    # the shorter text of a pair gives the bits
    turned = len_a > len_b
    short, longer = np.minimum(len_a, len_b), np.maximum(len_a, len_b)
    start_a = np.where(turned, starts[n:], starts[:n])
    start_b = np.where(turned, starts[:n], starts[n:])
    common = np.zeros(n, np.int64)
    order = np.lexsort((longer, short))
    order = order[short[order] > 0]
    wide = order[short[order] > 64 * LANE_WORDS]
    for i in wide:
        common[i] = _common_subsequence(first[i], second[i])
    lanes = order[: len(order) - len(wide)]
    # chunks of pairs alike in length, so that little is filled up and tables stay small
    step = 4096
    at = 0
    while at < len(lanes):
        some = lanes[at : at + step]
        a = _padded(codes, start_a[some], short[some])
        b = _padded(codes, start_b[some], longer[some])
        kinds = np.unique(a)
        kinds = kinds[kinds > 0]
        size = 8 * len(some) * (len(kinds) + 1) * (a.shape[1] // 64 + 1)
        if max(size, 8 * b.size) > _TABLE_BYTES and len(some) > 1:
            step = max(len(some) // 2, 1)
            continue
        rank_a, rank_b = np.searchsorted(kinds, a), np.searchsorted(kinds, b)
        known = kinds[np.minimum(rank_b, len(kinds) - 1)] == b
        common[some] = _lane_lengths(
            np.where(a > 0, rank_a + 1, 0), np.where(known, rank_b + 1, 0), len(kinds)
        )
        at += len(some)
    return common, len_a + len_b


@F.pandas_udf(T.IntegerType())
def _indel_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        common, total = _subsequence_lengths(left, right)
        score = np.where(total > 0, np.rint(200 * common / np.maximum(total, 1)), 100)
        yield pd.Series(score.astype(np.int32))


JACCARD_WORDS = Metric(_word_set, _jaccard_score, _jaccard_bound, _jaccard_band)
INDEL = Metric(lambda text: text, _indel_score, _indel_bound)
METRICS = {"jaccard_words": JACCARD_WORDS, "indel": INDEL}


def similarity(a: Column, b: Column, metric: Metric = JACCARD_WORDS) -> Column:
    """Similarity of two texts, 0..100."""
    return metric.score(metric.prepare(a), metric.prepare(b))


# Departments that never mix, and name conflicts. A conflict holds
# when the first product has a term of the left list and the second one of the right.
SEPARATE_DEPARTMENTS = [
    ("meat seafood", "produce"),
    ("dairy eggs", "household"),
    ("personal care", "pantry"),
    ("pets", "babies"),
]
NAME_CONFLICTS = [
    (["tea", "coffee"], ["peas", "beans"]),
    (["soap", "detergent"], ["food", "snack"]),
    (["dog", "cat", "pet"], ["baby", "infant"]),
]


def _conflict_bits(name: Column, side: int) -> Column:
    text = F.lower(name)
    bits = F.lit(0)
    for rule, sides in enumerate(NAME_CONFLICTS):
        has_term = F.lit(False)
        for term in sides[side]:
            has_term = has_term | F.contains(text, F.lit(term))
        bits = bits + F.when(has_term, 1 << rule).otherwise(0)
    return bits


def first_conflict_bits(name: Column) -> Column:
    """One bit per conflict rule whose left list the name touches."""
    return _conflict_bits(name, 0)


def second_conflict_bits(name: Column) -> Column:
    """One bit per conflict rule whose right list the name touches."""
    return _conflict_bits(name, 1)


def departments_mix(first: Column, second: Column) -> Column:
    """False for the department pairs that are kept apart, in either order."""
    apart = F.lit(False)
    for a, b in SEPARATE_DEPARTMENTS:
        apart = apart | ((first == a) & (second == b)) | ((first == b) & (second == a))
    return ~apart


def department_bits(department: Column) -> tuple[Column, Column]:
    """(left, right) bits: two departments mix if neither's left bits meet the other's right ones.

    A missing department is kept apart from every one that a rule names, as in ``departments_mix``.
    """

    def bits(side: int) -> Column:
        out = F.lit(0)
        for rule, pair in enumerate(SEPARATE_DEPARTMENTS):
            out = out + F.when(department.isNull() | (department == pair[side]), 1 << rule).otherwise(0)
        return out

    return bits(0), bits(1)


def compatible(dept1: Column, name1: Column, dept2: Column, name2: Column) -> Column:
    """Whether product 2 may join a family anchored by product 1."""
    clash = first_conflict_bits(name1).bitwiseAND(second_conflict_bits(name2))
    return departments_mix(dept1, dept2) & (clash == 0)


def shared_meaningful_words(query: Column, other: Column) -> Column:
    """Number of common words longer than three letters that are not fillers."""
    fillers = ["organic", "natural", "fresh", "premium"]  # fixed values
    common = F.array_intersect(
        F.split(F.lower(query), r"\s+"), F.split(F.lower(other), r"\s+")
    )
    return F.size(F.filter(common, lambda w: (F.length(w) > 3) & ~w.isin(fillers)))
