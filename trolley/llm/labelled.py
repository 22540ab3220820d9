"""Labelled training rows and logistic fits, shared by the text classifiers."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.functions.hashing import keyed_hash
from trolley.llm.lookup import content_hash

FOLDS = 5


def held_out(id_col: str | Column) -> Column:
    """Rows whose crc32 of the id as text is a multiple of five; never learnt from."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string")) % FOLDS == 0, F.lit(False))


def training_texts(
    docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int, id_col: str, text_col: str, seed: int
) -> DataFrame:
    """``(label, text)`` of at most ``sample_rows`` labelled ids outside the held-out fold, one row each.

    The sample is the ids of the least keyed hashes, so it does not depend on the
    partitioning. An id with several labels has the largest, an id with several texts
    the one of the least hash.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(keyed_hash(seed, "doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # at most ``sample_rows`` short rows are sent; a third of all documents may share an id
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sampled = texts.join(F.broadcast(known), "doc_id")
    return sampled.groupBy("doc_id", "label").agg(F.min_by("text", content_hash("text")).alias("text")).select("label", "text")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def least(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, settled: float) -> np.ndarray:
    """Where a convex loss (value and slope) is least, by L-BFGS from ``w`` on until it settles."""
    value, slope = loss(w)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=10)
    while True:
        step, pulls = -slope, []
        for moved, bent, curve in reversed(past):
            pulls.append((moved @ step) / curve)
            step = step - pulls[-1] * bent
        if past:
            step = step * (past[-1][2] / (past[-1][1] @ past[-1][1]))
        for (moved, bent, curve), pull in zip(past, reversed(pulls), strict=True):
            step = step + (pull - (bent @ step) / curve) * moved
        length, down = 1.0, float(slope @ step)
        while True:
            tried = w + length * step
            lower, there = loss(tried)
            if lower <= value + 1e-4 * length * down:
                break
            length /= 2
            if length < 1e-12:
                return w
        moved, bent = tried - w, there - slope
        if (curve := float(moved @ bent)) > 1e-12 * float(bent @ bent):
            past.append((moved, bent, curve))
        before, w, value, slope = value, tried, lower, there
        if before - value <= settled * before:
            return w
