"""Durable intermediate tables.

A step whose result is read more than once, or whose row order must not change
between two reads, is written to the shared folder named by
``spark.checkpoint.dir``. A lost executor then costs only its own tasks, and
later readers get column pruning and filter pushdown.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's own setting: shuffle files go with the action that made them
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None
# paths written in the open ``passing`` blocks, the innermost last
_passing: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only in local mode."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute narrow rows ahead of costly per-row work.

    The explicit number keeps adaptive execution from merging partitions that are
    small in bytes but long in computation.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def balanced(df: DataFrame, *keys: str, most: int | None = None) -> tuple[DataFrame, int]:
    """``df`` over enough partitions for costly per-row work, and its row count.

    One count by partition tells both. Input with fewer filled partitions than the
    cluster has cores (a few files, one row group) is redistributed; large input has
    plenty of partitions and stays where it is, unless a partition would hold more than
    ``most`` rows on average.
    """
    per_part = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    parts, rows = per_part.agg(F.count("*"), F.sum("n")).first()
    if parts < df.sparkSession.sparkContext.defaultParallelism:
        df = spread(df, *keys)
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if most and rows and rows > parts * most:
        df = df.repartition(-(-rows // most), *keys)
    return df, rows or 0


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if _passing:
        _passing[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, so that steps do not add up on the disk.

    Shuffle files are deleted at the end of each action inside, and do not wait for the
    driver to collect its garbage. Whatever is read later must be written inside an
    ``outliving`` block.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


@contextmanager
def outliving(blocks: int = 1) -> Iterator[None]:
    """Tables written inside outlive so many ``passing`` blocks and go with the next outer one."""
    inner = _passing[-blocks:]
    del _passing[-blocks:]
    try:
        yield
    finally:
        _passing.extend(inner)
