"""Exact nearest neighbours inside a bounded sample, and the quality report on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions.hashing import keyed_hash
from trolley.functions.similarity import shared_meaningful_words
from trolley.storage import written

SAMPLE_SIZE = 1000
SAMPLE_LIMIT = 20_000


def random_sample(df: DataFrame, key: str, n: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, with ``sample_no`` 0.. in random order."""
    picked = df.orderBy(keyed_hash(seed, key), key).limit(n)
    rows = picked.select(F.col(key).alias("_key"))
    # n keys at most: one short array gives the order without a global window
    order = rows.agg(
        F.sort_array(
            F.collect_list(F.struct(keyed_hash(seed, "_key").alias("h"), F.col("_key").alias("k")))
        ).alias("o")
    ).select(F.posexplode("o").alias("sample_no", "e"))
    return df.join(
        F.broadcast(order.select("sample_no", F.col("e.k").alias(key))), key
    )


def sample_neighbours(vectors: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar sampled rows of each sampled row, itself excluded.

    ``vectors`` are unit-length sparse rows (id, idx, weight) and ``sample`` lists
    (id, sample_no). The sample is bounded, so its matrix is shared once and every
    task scores its share of the rows; no pair is ever shuffled. Ties go by id.
    """
    spark = vectors.sparkSession
    ids = sample.select("id", "sample_no").orderBy("sample_no").toPandas()
    if len(ids) > SAMPLE_LIMIT:
        raise ValueError(f"the sample has more than {SAMPLE_LIMIT} rows")
    picked = vectors.join(F.broadcast(sample.select("id", "sample_no")), "id")
    rows = written(
        picked.groupBy("id", "sample_no").agg(
            F.collect_list("idx").alias("idx"), F.collect_list("weight").alias("weight")
        ),
        "sample-vectors",
    )
    local = rows.toPandas()
    used = np.unique(np.concatenate([np.asarray(i) for i in local["idx"]]))
    matrix = np.zeros((len(ids), len(used)))
    for number, idx, weight in zip(local["sample_no"], local["idx"], local["weight"]):
        matrix[number, np.searchsorted(used, idx)] = weight
    shared = spark.sparkContext.broadcast((ids["id"].to_numpy(), matrix))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ids, full = shared.value
        for batch in batches:
            numbers = batch["sample_no"].to_numpy()
            # equal vectors must tie exactly, so round before ranking
            scores = np.round(full[numbers] @ full.T, 9)
            scores[np.arange(len(numbers)), numbers] = -np.inf
            for row, number in enumerate(numbers):
                order = np.lexsort((all_ids, -scores[row]))[:k]
                order = order[order != number]
                yield pd.DataFrame(
                    {
                        "id": all_ids[number],
                        "sample_no": number,
                        "rank": np.arange(1, len(order) + 1),
                        "neighbour_id": all_ids[order],
                        "score": scores[row][order],
                    }
                )

    # every sampled id takes part, also one whose vector is all zero
    spread = sample.select("id", "sample_no").repartition("sample_no")
    return spread.mapInPandas(
        nearest,
        "id bigint, sample_no int, rank int, neighbour_id bigint, score double",
    )


def similarity_statistics(neighbours: DataFrame) -> DataFrame:
    """Mean, population deviation and 95th percentile of the neighbour scores."""
    return neighbours.agg(
        F.avg("score").alias("mean_similarity"),
        F.stddev_pop("score").alias("std_similarity"),
        F.percentile("score", 0.95).alias("p95_similarity"),
    )


def good_examples(
    neighbours: DataFrame,
    names: DataFrame,
    queries: int = 20,
    keep: int = 5,
    neighbours_per_query: int = 5,
) -> DataFrame:
    """Query products whose neighbours share two or more meaningful words with them.

    ``names`` is (id, product_name). Looks at the first ``queries`` sampled products
    and keeps the first ``keep`` good ones.
    """
    few = neighbours.where(
        (F.col("sample_no") < queries) & (F.col("rank") <= neighbours_per_query)
    )
    named = (
        F.broadcast(few)
        .join(names.select("id", F.col("product_name").alias("query")), "id")
        .join(
            names.select(
                F.col("id").alias("neighbour_id"), F.col("product_name").alias("neighbour")
            ),
            "neighbour_id",
        )
    )
    return (
        named.groupBy("sample_no", "id", "query")
        .agg(
            F.sum(shared_meaningful_words(F.col("query"), F.col("neighbour"))).alias("shared"),
            F.sort_array(F.collect_list(F.struct("rank", "neighbour", "score"))).alias("similar"),
        )
        .where("shared >= 2")
        .orderBy("sample_no")
        .limit(keep)
    )
