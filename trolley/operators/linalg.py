"""Truncated SVD of centred item vectors through their covariance.

Narrow vectors (tens to hundreds of columns) take one distributed pass that builds the
small covariance matrix; only that matrix is decomposed on the driver. Wide vectors take
a randomised range finder: no width x width matrix exists anywhere, and the driver holds
width x components numbers, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SvdModel(NamedTuple):
    """U (d x r), singular values, column means, explained variance per component.

    ``pca`` is the fitted projection and ``signs`` turns its columns into those of U.
    """

    pca: PCAModel
    signs: np.ndarray
    u: np.ndarray
    sigma: np.ndarray
    mean: np.ndarray
    explained: np.ndarray
    rows: int


def column_means(vectors: DataFrame, col: str = "embedding") -> np.ndarray:
    """Element-wise mean over all rows."""
    as_vector = array_to_vector(F.col(col).cast("array<double>"))
    return vectors.agg(Summarizer.mean(as_vector).alias("m")).first()["m"].toArray()


def centred(vectors: DataFrame, mean: np.ndarray, col: str = "embedding") -> DataFrame:
    """Subtract the column means."""
    shift = F.array(*[F.lit(float(x)) for x in mean])
    return vectors.withColumn(
        col, F.zip_with(F.col(col).cast("array<double>"), shift, lambda x, m: x - m)
    )


def truncated_svd(vectors: DataFrame, r: int, col: str = "embedding") -> SvdModel:
    """The ``r`` leading singular triplets of the centred row matrix, without V.

    Signs are fixed so that the entry of largest magnitude in each column of U is
    positive.
    """
    ready = vectors.select(array_to_vector(F.col(col).cast("array<double>")).alias("_x"))
    stats = ready.agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_x")).alias("s")
    ).select("s.mean", "s.variance", "s.count").first()
    total_variance = float(stats["variance"].toArray().sum())
    fitted = PCA(k=r, inputCol="_x", outputCol="_y").fit(ready)
    u = fitted.pc.toArray()
    signs = np.sign(u[np.abs(u).argmax(axis=0), np.arange(r)])
    explained = fitted.explainedVariance.toArray()
    n = int(stats["count"])
    sigma = np.sqrt(explained * total_variance * (n - 1))
    return SvdModel(fitted, signs, u * signs, sigma, stats["mean"].toArray(), explained, n)


def inverse_sigma(sigma: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """1 / sigma, and 0 where sigma is below ``tolerance`` times the largest."""
    real = sigma > tolerance * max(sigma.max(initial=0.0), np.finfo(float).tiny)
    return np.where(real, 1.0 / np.where(real, sigma, 1.0), 0.0)


def project(
    vectors: DataFrame, model: SvdModel, col: str = "embedding", scaled: bool = False
) -> DataFrame:
    """Add ``reduced``: the centred vector times U, divided by sigma when ``scaled``.

    Unscaled gives the reduced coordinates; scaled gives rows of V, which is also
    the map of any new vector into the reduced space. Components of a rank-deficient
    matrix whose singular value is only rounding error become 0, as in a pseudo-inverse.
    """
    scale = model.signs * inverse_sigma(model.sigma) if scaled else model.signs
    shifts = F.array(*[F.lit(float(v)) for v in model.mean @ (model.u * model.signs)])
    scales = F.array(*[F.lit(float(v)) for v in scale])
    raw = model.pca.transform(
        vectors.withColumn("_x", array_to_vector(F.col(col).cast("array<double>")))
    )
    return raw.withColumn(
        "reduced",
        F.transform(
            vector_to_array("_y"), lambda y, k: (y - F.get(shifts, k)) * F.get(scales, k)
        ),
    ).drop("_x", "_y")


class WideSvd(NamedTuple):
    """The fields of ``SvdModel`` that hold without a fitted projection."""

    u: np.ndarray
    sigma: np.ndarray
    mean: np.ndarray
    explained: np.ndarray
    rows: int


BASIS_BYTES = 256 << 20


def _rows_of(batch: pa.RecordBatch, mean: np.ndarray, at: int = 0) -> np.ndarray:
    """The centred vectors of a batch as a matrix."""
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean


def _scattered(vectors: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Scatter matrix times ``basis`` in one scan, without the scatter matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        for batch in batches:
            if batch.num_rows:
                x = _rows_of(batch, mean)
                total += x.T @ (x @ basis)
        if total.any():
            bounds = np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(total.ravel()))],
                names=["d", "part"],
            )

    summed = vectors.mapInArrow(partial, "d bigint, part array<double>").groupBy("d").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("part")))).alias("part")
    )
    out = np.zeros_like(basis)
    for row in summed.toLocalIterator():
        out[row["d"]] = row["part"]
    return out


def randomised_svd(
    vectors: DataFrame,
    r: int,
    col: str = "embedding",
    oversample: int = 10,
    rounds: int = 4,
    seed: int = 7,
    basis_bytes: int = BASIS_BYTES,
) -> WideSvd:
    """About the ``r`` leading singular triplets of the centred rows, for wide vectors.

    A random basis of ``r + oversample`` columns goes through ``rounds`` power iterations, one
    scan each, made orthogonal in between; one scan more gives the values inside it. It is
    exact if the basis is as wide as the vectors; else the error falls by the ratio of the
    first left out to the ``r``-th squared singular value with every round. A basis over
    ``basis_bytes`` is an error. Signs are those of ``truncated_svd``.
    """
    ready = vectors.select(F.col(col).cast("array<double>").alias("x"))
    stats = ready.select(array_to_vector("x").alias("x")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("x")).alias("s")
    ).select("s.mean", "s.variance", "s.count").first()
    mean, n = stats["mean"].toArray(), int(stats["count"])
    energy = float(stats["variance"].toArray().sum()) * (n - 1)
    size = min(r + oversample, len(mean))
    if len(mean) * size * 8 > basis_bytes:
        raise ValueError(f"a basis of {len(mean)} x {size} numbers is over {basis_bytes} bytes")
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), size)))[0]
    for _ in range(rounds if size < len(mean) else 0):
        basis = np.linalg.qr(_scattered(ready, basis, mean))[0]
    inner = basis.T @ _scattered(ready, basis, mean)
    squares, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-squares)[:r]
    u = basis @ turn[:, order]
    u *= np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    squares = np.maximum(squares[order], 0.0)
    explained = squares / energy if energy > 0 else np.zeros_like(squares)
    return WideSvd(u, np.sqrt(squares), mean, explained, n)


def project_wide(
    vectors: DataFrame, model: WideSvd, col: str = "embedding", scaled: bool = False
) -> DataFrame:
    """``project`` for a model of ``randomised_svd``: all columns and ``reduced``, in Arrow batches."""
    u = model.u * inverse_sigma(model.sigma) if scaled else model.u
    mean = model.mean

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _rows_of(batch, mean, batch.num_columns - 1) @ u
            bounds = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            reduced = pa.ListArray.from_arrays(pa.array(bounds), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], reduced], names=[*batch.schema.names[:-1], "reduced"])

    fields = [f for f in vectors.schema.fields if f.name != "reduced"]
    ready = vectors.select(*[F.col(f.name) for f in fields], F.col(col).cast("array<double>").alias("reduced"))
    return ready.mapInArrow(place, ready.schema)


def singular_report(model: SvdModel | WideSvd, spark: SparkSession) -> DataFrame:
    """(component, singular_value, explained_ratio, cumulative_retained), r rows.

    ``explained_ratio`` is over the total variance, ``cumulative_retained`` over the
    retained components only.
    """
    power = model.sigma**2
    retained = np.cumsum(power) / power.sum()
    rows = zip(range(1, len(power) + 1), model.sigma, model.explained, retained)
    return spark.createDataFrame(
        [(k, float(s), float(e), float(c)) for k, s, e, c in rows],
        "component int, singular_value double, explained_ratio double, cumulative_retained double",
    )


def factor_u(model: SvdModel, spark: SparkSession) -> DataFrame:
    """(dimension, component, value) of U; d x r numbers."""
    return spark.createDataFrame(
        [
            (int(i), int(k), float(model.u[i, k]))
            for i in range(model.u.shape[0])
            for k in range(model.u.shape[1])
        ],
        "dimension int, component int, value double",
    )
