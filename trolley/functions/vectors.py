"""Vector expressions over ``array<double>`` and ``array<float>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_total(F.transform(_doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_normalise(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, _doubles(v)).otherwise(
        F.transform(_doubles(v), lambda x: x / length)
    )


def subtract(a: Column, b: Column) -> Column:
    """Element-wise difference."""
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x - y)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return norm(subtract(a, b))


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean, combined map-side before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(_doubles(v))))
