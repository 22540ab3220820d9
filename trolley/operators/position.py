"""Dense global positions without a single-partition window.

The rows are range-partitioned and sorted on the order columns, numbered inside
their partition and written; the offsets of the partitions come from one small
aggregate. The written copy pins the sampled range bounds between the counting
and the numbering read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.storage import written

# monotonically_increasing_id keeps the row number in the low 33 bits
_ROW_BITS = 33


def add_offsets(
    df: DataFrame, part: str, index: str, name: str, start: int = 0, broadcast: bool = True
) -> DataFrame:
    """Turn (part, 0-based index in part) into a position over all parts in part order.

    The offset table has one row per part, so it stays small however many rows
    the parts hold; the window runs over that table only. ``broadcast`` is for
    callers that know the number of parts to be small.
    """
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(part)
        .agg(F.count("*").alias("_n"))
        .select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    offsets = F.broadcast(offsets) if broadcast else offsets
    return df.join(offsets, part).withColumn(
        name, (F.col("_offset") + F.col(index) + F.lit(start)).cast("bigint")
    ).drop("_offset")


def with_positions(
    df: DataFrame, order: list[str], name: str = "pos", start: int = 0
) -> DataFrame:
    """Add the dense position of each row in the global order of ``order``."""
    slotted = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_slot", _ROW_BITS).cast("int"))
        .withColumn("_index", F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_slot"),
        "positions",
    )
    # one part per range partition, so the offsets number at most the shuffle partitions
    return add_offsets(slotted, "_part", "_index", name, start).drop("_part", "_index")


def with_key_positions(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "key_pos",
    count_name: str = "key_rows",
) -> DataFrame:
    """Add the 0-based position of each row inside its key, and the key's row count.

    The keys are counted first. Ordinary keys are numbered in one window. A key with
    more rows than an even share of a shuffle partition (there are fewer of them than
    partitions) spans many range partitions, so no task ever sorts it as a whole.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias(count_name))
    total, largest = counts.agg(F.sum(count_name), F.max(count_name)).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not total or largest * parts <= total:
        return _window_positions(df, keys, order, name, count_name)
    hot = written(counts.where(F.col(count_name) * parts > F.lit(total)), "hot-keys")
    sent = F.broadcast(hot.select(*keys))
    ordinary = _window_positions(df.join(sent, keys, "left_anti"), keys, order, name, count_name)
    placed = with_positions(df.join(sent, keys, "left_semi"), keys + order, "_pos")
    firsts = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"), F.count("*").alias(count_name))
    numbered = (
        placed.join(F.broadcast(firsts), keys)
        .withColumn(name, F.col("_pos") - F.col("_first"))
        .drop("_pos", "_first")
    )
    return ordinary.unionByName(numbered)


def _window_positions(
    df: DataFrame, keys: list[str], order: list[str], name: str, count_name: str
) -> DataFrame:
    own = W.partitionBy(*keys)
    return df.withColumns(
        {
            name: (F.row_number().over(own.orderBy(*order)) - 1).cast("bigint"),
            count_name: F.count("*").over(own),
        }
    )
