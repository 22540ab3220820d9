"""Clustering of item vectors and scores of a clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.functions.vectors import dot, euclidean, mean_vector, subtract
from trolley.operators.linalg import column_means
from trolley.operators.skew import attach_by_key

NOISE = -1


def _vectors(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(col).cast("array<double>")))


class Centres(NamedTuple):
    """The best restart: its centres, the sum of squared distances, its rounds and number."""

    centres: list[list[float]]
    cost: float
    rounds: int
    restart: int


def _first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of a bounded sample, each drawn by its squared distance from those before."""
    centres = [sample[rng.integers(len(sample))]]
    apart = np.full(len(sample), np.inf)
    while len(centres) < k:
        apart = np.minimum(apart, ((sample - centres[-1]) ** 2).sum(axis=1))
        if not apart.sum():
            break  # fewer different rows than clusters
        centres.append(sample[rng.choice(len(sample), p=apart / apart.sum())])
    return np.array(centres)


def _cluster_sums(centres: dict[int, np.ndarray]):
    """Per task: count, cost and sum of the rows nearest to each centre of every restart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {r: np.zeros(len(c)) for r, c in centres.items()}
        costs = {r: np.zeros(len(c)) for r, c in centres.items()}
        sums = {r: np.zeros(c.shape) for r, c in centres.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            lengths = (x * x).sum(axis=1)
            for r, c in centres.items():
                apart = lengths[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
                own = apart.argmin(axis=1)
                least = np.maximum(apart[np.arange(len(x)), own], 0)
                mine = own[:, None] == np.arange(len(c))
                counts[r] += mine.sum(axis=0)
                costs[r] += np.bincount(own, least, len(c))
                sums[r] += mine.T.astype(float) @ x
        rows = [(r, i, counts[r][i], costs[r][i], sums[r][i]) for r, c in centres.items() for i in range(len(c))]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in rows], t) for i, t in enumerate(types)],
            names=["restart", "cluster", "n", "cost", "total"],
        )

    return add


def _add_up(parts: pa.Table) -> pa.Table:
    """The sums of one centre over all tasks, of which there are few."""
    total = parts["total"].combine_chunks().flatten().to_numpy().reshape(parts.num_rows, -1).sum(axis=0)
    n, cost = (float(parts[c].to_numpy().sum()) for c in ("n", "cost"))
    columns = [parts["restart"].slice(0, 1), parts["cluster"].slice(0, 1), pa.array([n]), pa.array([cost])]
    return pa.table([*columns, pa.array([total], pa.list_(pa.float64()))], names=["restart", "cluster", "n", "cost", "total"])


def fit_kmeans(
    vectors: DataFrame,
    col: str = "embedding",
    k: int = 5,
    restarts: int = 20,
    max_iter: int = 300,
    seed: int = 42,
    tolerance: float = 1e-4,
    sample_rows: int = 10_000,
) -> Centres:
    """The best of ``restarts`` k-means runs by cost, all of them in one scan per round.

    The first centres come from at most ``sample_rows`` rows. A round reads the vectors
    once, adds up the rows nearest to each centre of every restart that still moves, and
    moves the centres; the driver sees restarts * k sums. A restart is done when no centre
    moves by more than ``tolerance``. The vectors are kept in memory meanwhile, spilling
    to disk. Rows without a vector take no part; fewer different rows than ``k`` give as
    many centres as there are.
    """
    ready = vectors.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("x")).persist()
    schema = "restart int, cluster int, n double, cost double, total array<double>"
    try:
        sample = ready.orderBy(F.xxhash64("x")).limit(sample_rows).toArrow()
        if not sample.num_rows:
            raise ValueError("there are no vectors to cluster")
        rows = sample["x"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
        rng = np.random.default_rng(seed)
        centres = {r: _first_centres(rows, k, rng) for r in range(restarts)}
        cost, rounds, moving = dict.fromkeys(centres, np.inf), dict.fromkeys(centres, 0), set(centres)
        for _ in range(max_iter):
            active = {r: centres[r] for r in sorted(moving)}
            sums = ready.mapInArrow(_cluster_sums(active), schema).groupBy("restart", "cluster").applyInArrow(_add_up, schema)
            moved, costs = {r: c.copy() for r, c in active.items()}, dict.fromkeys(active, 0.0)
            # restarts * k rows
            for row in sums.collect():
                costs[row["restart"]] += row["cost"]
                if row["n"]:
                    moved[row["restart"]][row["cluster"]] = np.array(row["total"]) / row["n"]
            for r, c in active.items():
                if np.sqrt(((moved[r] - c) ** 2).sum(axis=1)).max() <= tolerance:
                    moving.discard(r)
                centres[r], cost[r], rounds[r] = moved[r], costs[r], rounds[r] + 1
            if not moving:
                break
        best = min(cost, key=lambda r: (cost[r], r))
        return Centres(centres[best].tolist(), cost[best], rounds[best], best)
    finally:
        ready.unpersist()


def _distances(found: Centres, col: str) -> Column:
    known = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in found.centres])
    value = F.col(col).cast("array<double>")
    return F.transform(known, lambda c: euclidean(value, c))


def assign_clusters(vectors: DataFrame, found: Centres, col: str = "embedding") -> DataFrame:
    """Add ``cluster``: the nearest centre, the first of equally near ones."""
    distances = _distances(found, col)
    return vectors.withColumn("cluster", (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


def silhouette(vectors: DataFrame, cluster: str = "cluster", col: str = "embedding") -> float:
    """Mean silhouette under squared Euclidean distance, from per-cluster sums."""
    return ClusteringEvaluator(featuresCol="_x", predictionCol=cluster).evaluate(
        _vectors(vectors, col)
    )


def cluster_centres(
    vectors: DataFrame, cluster: str = "cluster", col: str = "embedding"
) -> DataFrame:
    """(cluster, size, centre)."""
    return vectors.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("size"), mean_vector(F.col(col)).alias("centre")
    )


def with_centre_distance(
    vectors: DataFrame, cluster: str = "cluster", col: str = "embedding"
) -> DataFrame:
    """Add ``size``, ``centre`` of the row's cluster and the squared distance to it."""
    named = vectors.withColumnRenamed(cluster, "cluster") if cluster != "cluster" else vectors
    placed = attach_by_key(named, cluster_centres(named, "cluster", col), ["cluster"], "size")
    gap = subtract(F.col(col), F.col("centre"))
    return placed.withColumn("sq_distance", dot(gap, gap))


def calinski_harabasz(
    vectors: DataFrame, cluster: str = "cluster", col: str = "embedding"
) -> DataFrame:
    """One row: rows, clusters, within and between sums of squares and their score."""
    placed = with_centre_distance(vectors, cluster, col)
    overall = F.array(*[F.lit(float(x)) for x in column_means(vectors, col)])
    per_cluster = placed.groupBy("cluster").agg(
        F.first("size").alias("size"),
        F.first("centre").alias("centre"),
        F.sum("sq_distance").alias("within"),
    )
    gap = subtract(F.col("centre"), overall)
    sums = (
        per_cluster.withColumn("between", F.col("size") * dot(gap, gap))
        .agg(
            F.sum("size").alias("n_rows"),
            F.count("*").alias("n_clusters"),
            F.sum("within").alias("within"),
            F.sum("between").alias("between"),
        )
    )
    score = F.try_divide(
        F.col("between") * (F.col("n_rows") - F.col("n_clusters")),
        F.col("within") * (F.col("n_clusters") - 1),
    )
    return sums.withColumn("calinski_harabasz", score)


def combined_score(silhouette_score: Column, ch_score: Column) -> Column:
    """Silhouette plus a ten-thousandth of the Calinski-Harabasz score."""
    return silhouette_score + ch_score / F.lit(10000.0)


def noise_ratio(vectors: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Share of rows assigned to no cluster."""
    return vectors.agg(
        F.avg((F.col(cluster) == NOISE).cast("int")).alias("noise_ratio")
    )


def cluster_coherence(
    vectors: DataFrame,
    cluster: str,
    category: str,
    id_col: str = "item_id",
    col: str = "embedding",
    inspected: int = 15,
) -> DataFrame:
    """(cluster, cluster_size, category, coherence): the category most common among
    the ``inspected`` rows nearest to the centre, and its share of them.

    Rows without a category count for the centre but are not inspected. The rank
    limit is applied in part before the shuffle, so a large cluster sends only its
    nearest rows.
    """
    placed = with_centre_distance(vectors, cluster, col).where(F.col(category).isNotNull())
    rank = F.row_number().over(W.partitionBy("cluster").orderBy("sq_distance", id_col))
    nearest = placed.withColumn("_rank", rank).where(F.col("_rank") <= inspected)
    counted = nearest.groupBy("cluster", category).agg(
        F.count("*").alias("n"), F.first("size").alias("cluster_size")
    )
    by_cluster = W.partitionBy("cluster")
    top = F.row_number().over(by_cluster.orderBy(F.desc("n"), category))
    share = F.col("n") / F.sum("n").over(by_cluster)
    return (
        counted.withColumn("_top", top)
        .withColumn("coherence", share)
        .where("_top = 1")
        .select("cluster", "cluster_size", category, "coherence")
    )


def category_representation(coherence: DataFrame, category: str) -> DataFrame:
    """(category, clusters, items, share): how many clusters a category dominates.

    ``items`` counts the rows of those clusters, ``share`` is of all clusters.
    """
    dominated = coherence.groupBy(category).agg(
        F.count("*").alias("clusters"), F.sum("cluster_size").alias("items")
    )
    every = coherence.count()
    return dominated.withColumn("share", F.col("clusters") / F.lit(every))


def kmeans_facts(assigned: DataFrame, found: Centres, col: str) -> DataFrame:
    """One row: rows, clusters, rows that are not at their nearest centre, and the largest
    gap between a centre and the mean of its rows (in any dimension)."""
    # k centres, as many as the caller asked for
    known = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in found.centres])
    value = F.col(col).cast("array<double>")
    distances = _distances(found, col)
    own = F.get(distances, F.col("cluster"))
    means = assigned.select("cluster", F.posexplode(value).alias("d", "x")).groupBy("cluster", "d").agg(
        F.avg("x").alias("mean")
    )
    gap = F.abs(F.col("mean") - F.get(F.get(known, F.col("cluster")), F.col("d")))
    return assigned.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("cluster").alias("n_clusters"),
        F.count_if(own > F.array_min(distances) + 1e-9).alias("misplaced"),
        F.lit(means.agg(F.max(gap)).first()[0]).alias("largest_gap"),
    )


def coherence_summary(coherence: DataFrame, category: str) -> DataFrame:
    """One row: clusters, mean coherence and number of distinct dominant categories."""
    return coherence.agg(
        F.count("*").alias("total_clusters"),
        F.avg("coherence").alias("average_coherence"),
        F.countDistinct(category).alias("category_coverage"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Success rate of a parameter grid from (method, params, succeeded) rows."""
    ok = F.count_if("succeeded")
    return runs.agg(
        F.countDistinct("method").alias("total_methods_tested"),
        F.count("*").alias("total_parameter_combinations"),
        ok.alias("successful_combinations"),
        F.try_divide(ok, F.count("*")).alias("success_rate"),
    )


RUN_COLUMNS = (
    "method string, params string, succeeded boolean, silhouette double, calinski_harabasz double, failure string"
)


def run_grid(
    vectors: DataFrame,
    grid: list[tuple[str, str, Callable[[DataFrame], DataFrame]]],
    cluster: str = "cluster",
    col: str = "embedding",
) -> DataFrame:
    """(method, params, succeeded, silhouette, calinski_harabasz, failure): one row per run.

    Each run of ``grid`` is (method, params, build); ``build`` adds the cluster column to
    the vectors. Rows of noise are not scored. A run fails, and the grid goes on, if it
    raises or leaves fewer than two clusters; ``failure`` then says why. Clusters without
    any spread have no Calinski-Harabasz score. ``run_summary`` and ``best_run`` take the
    result.
    """
    rows = []
    for method, params, build in grid:
        try:
            found = build(vectors).where(F.col(cluster) != NOISE)
            n_clusters = found.agg(F.countDistinct(cluster)).first()[0]
            if n_clusters < 2:
                raise ValueError(f"{n_clusters} clusters, two are needed")
            score = calinski_harabasz(found, cluster, col).first()["calinski_harabasz"]
            rows.append((method, params, True, float(silhouette(found, cluster, col)), score, None))
        except Exception as error:  # whatever ends a run is its result
            rows.append((method, params, False, None, None, f"{type(error).__name__}: {error}"))
    return vectors.sparkSession.createDataFrame(rows, RUN_COLUMNS)


def best_run(runs: DataFrame) -> DataFrame:
    """The run with the highest combined score from (method, params, silhouette, ch)."""
    score = combined_score(F.col("silhouette"), F.col("calinski_harabasz"))
    return runs.withColumn("combined_score", score).orderBy(
        F.desc("combined_score"), "method", "params"
    ).limit(1)
