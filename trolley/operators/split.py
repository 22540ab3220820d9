"""Exact-size random splits and samples by keyed hash, without a global sort.

Rows are counted per hash prefix; the prefix in which the wanted share ends is
found from those counts, and only the keys of that one prefix (about one in
65,536) are ranked to find the exact cut. Splitting is then one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.functions.hashing import keyed_hash
from trolley.operators.skew import attach_by_key

PREFIX_DIGITS = 4


def _up_to(key: Column, cut_hash: Column, cut_key: Column) -> Column:
    """Whether a row is at or before the cut in (hash, key) order."""
    return (F.col("_h") < cut_hash) | ((F.col("_h") == cut_hash) & (key <= cut_key))


def assign_split(
    df: DataFrame, key: str = "user_id", val_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: exactly ceil(n * val_fraction) rows are 'val', the rest 'train'.

    ``key`` identifies a row. Finding the cut reads the key column only; the rows
    themselves are never shuffled.
    """
    keys = df.select(F.col(key).alias("_k"), keyed_hash(seed, key).alias("_h")).withColumn(
        "_p", F.substring("_h", 1, PREFIX_DIGITS)
    )
    counts = keys.groupBy("_p").agg(F.count("*").alias("_n"))
    # at most 65,536 prefixes, so these windows and their result are small
    every = W.partitionBy(F.lit(0))
    running = counts.withColumn(
        "_upto", F.sum("_n").over(every.orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    ).withColumn("_wanted", F.ceil(F.sum("_n").over(every) * F.lit(val_fraction)))
    edge = running.where(F.col("_upto") >= F.col("_wanted")).orderBy("_p").first()
    if edge is None or edge["_wanted"] == 0:
        return df.withColumn("split", F.lit("train"))
    left = edge["_wanted"] - (edge["_upto"] - edge["_n"])
    rank = F.row_number().over(W.partitionBy("_p").orderBy("_h", "_k"))
    cut = (
        keys.where(F.col("_p") == edge["_p"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") == left)
        .first()
    )
    chosen = _up_to(F.col(key), F.lit(cut["_h"]), F.lit(cut["_k"]))
    return (
        df.withColumn("_h", keyed_hash(seed, key))
        .withColumn("split", F.when(chosen, "val").otherwise("train"))
        .drop("_h")
    )


def split_counts(df: DataFrame) -> DataFrame:
    """(split, n)."""
    return df.groupBy("split").agg(F.count("*").alias("n"))


def stratified_sample(
    df: DataFrame, stratum: str, key: str, cap: int, seed: int = 42
) -> DataFrame:
    """About ``cap`` rows, each stratum keeping cap * its share of its rows, rounded up.

    So no stratum disappears, and there are at most as many rows above ``cap`` as strata. With ``cap`` rows or fewer everything is kept. Within a stratum the rows with
    the smallest keyed hash are taken, exactly as many as its quota.
    """
    n = df.count()
    if n <= cap:
        return df
    keys = df.select(
        stratum, F.col(key).alias("_k"), keyed_hash(seed, key).alias("_h")
    ).withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    counts = keys.groupBy(stratum, "_p").agg(F.count("*").alias("_n"))
    # a stratum has at most 65,536 prefixes, whatever its size
    in_stratum = W.partitionBy(stratum)
    before = in_stratum.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    edges = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_rows", F.sum("_n").over(in_stratum))
        .withColumn("_quota", F.ceil(F.col("_rows") * cap / F.lit(n)))
        .where(
            (F.col("_before") < F.col("_quota"))
            & (F.col("_quota") <= F.col("_before") + F.col("_n"))
        )
        .select(stratum, "_p", (F.col("_quota") - F.col("_before")).alias("_left"), "_rows")
    )
    rank = F.row_number().over(W.partitionBy(stratum, "_p").orderBy("_h", "_k"))
    cuts = (
        keys.join(edges, [stratum, "_p"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_left"))
        .select(stratum, F.col("_h").alias("_cut_h"), F.col("_k").alias("_cut_k"), "_rows")
    )
    hashed = df.withColumn("_h", keyed_hash(seed, key))
    chosen = _up_to(F.col(key), F.col("_cut_h"), F.col("_cut_k"))
    return (
        attach_by_key(hashed, cuts, [stratum], "_rows")
        .where(chosen)
        .drop("_h", "_cut_h", "_cut_k", "_rows")
    )
