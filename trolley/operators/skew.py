"""Joining per-key facts onto the rows of their key when some keys are huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.storage import spread, written


def attach_by_key(
    df: DataFrame,
    stats: DataFrame,
    keys: list[str],
    rows_col: str,
    how: str = "inner",
    cheap: bool = False,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Join ``stats`` (one row per key) to ``df`` without sending a hot key to one task.

    ``rows_col`` of ``stats`` holds the number of rows per key; a missing or zero count
    is that of an ordinary key. A key is hot when it holds more than an even share of a
    shuffle partition, so there are fewer hot keys than shuffle partitions whatever the
    data. Hot keys are joined by broadcast and their rows never shuffle; the others take
    an ordinary join. ``stats`` is read several times, so it is written first unless it
    is ``cheap`` to read again.

    With ``spread_by`` costly work may follow in the same stage: rows of ordinary keys meet
    their facts in as many partitions as there are, those of hot keys are dealt by these
    columns ahead of the join. So wide facts never travel beside the rows.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    if not cheap:
        stats = written(stats, "key-stats")
    total, largest, n_keys = stats.agg(F.sum(rows_col), F.max(rows_col), F.count("*")).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # as few keys as there could be hot ones: one broadcast of them all is the whole job
    if n_keys <= parts:
        dealt = spread(df, *spread_by) if spread_by else df
        return dealt.join(F.broadcast(stats), keys, how)
    if not total or largest * parts <= total:
        return (spread(df, *keys) if spread_by else df).join(stats, keys, how)
    is_hot = F.coalesce(F.col(rows_col) * parts > F.lit(total), F.lit(False))
    hot, warm = stats.where(is_hot), stats.where(~is_hot)
    other_rows = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    if spread_by:
        df = spread(df.join(F.broadcast(hot.select(*keys)), keys, "left_semi"), *spread_by)
        other_rows = spread(other_rows, *keys)
    hot_rows = df.join(F.broadcast(hot), keys, "inner")
    other_rows = other_rows.join(warm, keys, how)
    return hot_rows.unionByName(other_rows)
