"""Distribution reports over baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.operators.baskets import Baskets


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal-width bins over an integer column, empty ones included.

    The last bin is closed; a constant column gets a range of width one around it.
    """
    low, high = df.agg(F.min(col), F.max(col)).first()
    spark = df.sparkSession
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if low is None:
        counted = df.limit(0).select(F.lit(0).alias("bin"), F.lit(0).alias("n"))
        low, high = 0, 1
    elif low == high:
        counted = df.where(F.col(col).isNotNull()).groupBy(F.lit(bins // 2).alias("bin")).agg(
            F.count("*").alias("n")
        )
        low, high = low - 0.5, high + 0.5
    else:
        index = F.least(
            F.floor((F.col(col) - low) * bins / F.lit(high - low)), F.lit(bins - 1)
        )
        counted = (
            df.where(F.col(col).isNotNull())
            .groupBy(index.cast("int").alias("bin"))
            .agg(F.count("*").alias("n"))
        )
    width = (high - low) / bins
    return edges.join(counted, "bin", "left").select(
        "bin",
        (F.lit(float(low)) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(float(low)) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def sequence_lengths(baskets: Baskets) -> DataFrame:
    """(user_id, n): history baskets per user."""
    return baskets.headers.where("is_target").select(
        "user_id", (F.col("n_baskets") - 1).alias("n")
    )


def basket_statistics(baskets: Baskets, bins: int = 20) -> DataFrame:
    """Histograms of sequence length, basket size and target size, one per ``measure``."""
    history = baskets.headers.where("NOT is_target").select(F.col("n_items").alias("n"))
    target = baskets.headers.where("is_target").select(F.col("n_items").alias("n"))
    reports = {
        "sequence_length": sequence_lengths(baskets),
        "basket_size": history,
        "target_size": target,
    }
    out = None
    for measure, df in reports.items():
        part = histogram(df, "n", bins).select(F.lit(measure).alias("measure"), "*")
        out = part if out is None else out.unionByName(part)
    return out
