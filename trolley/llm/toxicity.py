"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes ratios.

An n-gram that a text holds counts as the log of how much likelier toxic texts hold it
than others; a logistic regression learns the weights of these scaled features. N-grams
are hashed to a fixed number of buckets, and the buckets that tell the labels apart best
are the features, so the model is bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.labelled import held_out, least, sigmoid, training_texts
from trolley.llm.spans import mixed, slices
from trolley.storage import written

SAMPLE_ROWS = 12_000
SIZES = (4, 5, 6)
BUCKET_BITS = 20
FEATURES = 12_000
SMOOTHING = 1.0
RIDGE = 1e-4
# the loss has settled when a round lowers it by a smaller share
SETTLED = 1e-6
SEED = 10
THRESHOLD = 0.5

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, lower-cased and with single kinds of white space, and the row bounds."""
    leads = (data & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(leads)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    if len(points) != bounds[-1]:  # text that is no UTF-8: its bytes are its characters
        points, bounds = data.astype(np.uint32), offsets
    upper = ((points >= 0x41) & (points <= 0x5A)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    points[upper] += 0x20
    points[points <= 0x20] = 0x20
    return points, bounds


def buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, the bucket of every n-gram of the slice and its row."""
    points, bounds = _characters(data, offsets)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    wide = points.astype(np.uint64)
    for n in SIZES:
        count = len(wide) - n + 1
        if count <= 0:
            continue
        h = np.full(count, _U(n))
        for i in range(n):
            h = h * _STEP + wide[i : i + count]
        inside = row[:count] == row[n - 1 :]
        yield (mixed(h) >> _U(64 - BUCKET_BITS)).astype(np.int64)[inside], row[:count][inside]


def _pairs(data: np.ndarray, offsets: np.ndarray, slot: np.ndarray | None, width: int) -> np.ndarray:
    """Distinct ``row * width + feature`` of a slice; ``slot`` maps buckets to features or -1."""
    found = []
    for bucket, row in buckets(data, offsets):
        feature = bucket if slot is None else slot[bucket]
        if slot is not None:
            known = feature >= 0
            feature, row = feature[known], row[known]
        found.append(row.astype(np.int64) * width + feature)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Ratios:
    """The features: their buckets in ascending order, log-count ratios, weights and bias."""

    buckets: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def slots(self) -> np.ndarray:
        slot = np.full(1 << BUCKET_BITS, -1, np.int64)
        slot[self.buckets] = np.arange(len(self.buckets))
        return slot

    def scores(self, data: np.ndarray, offsets: np.ndarray, slot: np.ndarray) -> np.ndarray:
        rows, width = len(offsets) - 1, max(len(self.buckets), 1)
        pairs = _pairs(data, offsets, slot, width)
        pull = (self.ratios * self.weights)[pairs % width] if len(pairs) else np.zeros(0)
        return sigmoid(np.bincount(pairs // width, pull, rows) + self.bias)


def _document_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets held by two texts at least, with the numbers of toxic and other texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            label = np.asarray(batch.column(0)) > 0
            for first, data, offsets in slices(batch.column(1)):
                pairs = _pairs(data, offsets, None, 1 << BUCKET_BITS)
                toxic = label[first + (pairs >> BUCKET_BITS)]
                own = pairs & ((1 << BUCKET_BITS) - 1)
                totals[0] += np.bincount(own[~toxic], minlength=1 << BUCKET_BITS)
                totals[1] += np.bincount(own[toxic], minlength=1 << BUCKET_BITS)
        used = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])],
            names=["bucket", "clean", "toxic"],
        )

    found = (
        texts.mapInArrow(count, "bucket bigint, clean bigint, toxic bigint")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("clean + toxic > 1")
        .toPandas()  # one row per bucket at most
        .sort_values("bucket")
    )
    return tuple(found[c].to_numpy(np.int64) for c in ("bucket", "clean", "toxic"))


def _sample_pairs(texts: DataFrame, model: Ratios) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and row and feature of what the sample's texts hold of the model's features."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, width = model.slots(), len(model.buckets)
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                pairs = _pairs(data, offsets, slot, width)
                n = len(offsets) - 1
                bounds = np.searchsorted(pairs, np.arange(n + 1) * width).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(bounds), pa.array((pairs % width).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), held], names=["label", "held"]
                )

    # bounded by the sample's rows and the number of features
    found = texts.mapInArrow(build, "label int, held array<int>").toArrow().combine_chunks()
    label = found["label"].to_numpy() > 0
    held = found["held"].combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    lengths = np.diff(held.offsets.to_numpy())
    feature = held.values.to_numpy()[held.offsets.to_numpy()[0] :][: lengths.sum()]
    return label, np.repeat(np.arange(len(label)), lengths), feature


def fit(texts: DataFrame) -> Ratios:
    """Ratios from document counts, then the weights of least log loss."""
    bucket, clean, toxic = _document_counts(texts)
    ratio = np.log((toxic + SMOOTHING) / (toxic.sum() + SMOOTHING * max(len(bucket), 1))) - np.log(
        (clean + SMOOTHING) / (clean.sum() + SMOOTHING * max(len(bucket), 1))
    )
    # first the features whose toxic texts are more, or fewer, than chance would explain; noise is left to the ridge
    expected = (toxic + clean) * (toxic.sum() / max((toxic + clean).sum(), 1))
    strength = np.abs(toxic - expected) / np.sqrt(np.maximum(expected, 1e-9))
    best = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    model = Ratios(bucket[best], ratio[best], np.ones(len(best)), 0.0)
    if not len(best):
        return Ratios(model.buckets, model.ratios, model.weights, 2.0 if toxic.sum() > clean.sum() else -2.0)
    label, row, feature = _sample_pairs(texts, model)
    if label.all() or not label.any():
        return Ratios(model.buckets, model.ratios, model.weights * 0, 2.0 if label.any() else -2.0)
    n, width = len(label), len(best)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, (model.ratios * w[:-1])[feature], n) + w[-1]
        miss = sigmoid(z) - label
        slope = np.append(np.bincount(feature, miss[row], width) * model.ratios / n + RIDGE * w[:-1], miss.mean())
        return float(np.mean(np.logaddexp(0, z) - label * z) + RIDGE / 2 * w[:-1] @ w[:-1]), slope

    start = np.append(np.zeros(width), np.log(label.mean() / (1 - label.mean())))
    *weights, bias = least(loss, start, SETTLED)
    weights = np.array(weights)
    return Ratios(model.buckets, model.ratios, weights, float(bias))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 from ``THRESHOLD`` on).

    Only the text counts. At most ``sample_rows`` labelled rows outside the held-out fold
    are learnt from; all rows are scored, whole texts each. A null or empty text holds no
    n-gram and gets the score of the bias; rows with a null id are scored but never
    learnt from; repeated rows get equal scores. Without labels of both kinds the score
    is the same for all. Other columns are not read.
    """
    texts = written(
        training_texts(docs, labels, label_col, sample_rows, id_col, text_col, SEED), "toxicity-sample"
    )
    model = fit(texts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = model.slots()
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                scores = model.scores(data, offsets, slot)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(scores)), pa.array(scores)], names=["doc_id", "score"]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
