"""Top-k recommendation and list metrics: precision, recall, hit, NDCG, MRR, coverage, entropy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.operators.baskets import Baskets
from trolley.operators.ranking import unit_rows
from trolley.operators.vocab import item_frequencies
from trolley.storage import written

CUTOFFS = [1, 5, 10, 15, 20, 50]
# profiles of one cell, and items of one cell; two such blocks are in a task at a time. Each
# further block of items sends every user another list of k, so these are large
BLOCK_BYTES, ITEM_BLOCK_BYTES = 32 * 1024 * 1024, 192 * 1024 * 1024
# scores in memory at a time, those looked through at a time, and pairs scored exactly
USERS_AT_ONCE, ITEMS_AT_ONCE = 512, 4_096
STRETCH = 256
PAIRS_AT_ONCE = 2_000
SCORE_DIGITS = 12
# scores are kept as whole numbers of their last digit; no score is as low as this
UNIT = 10**SCORE_DIGITS
NONE_YET = -2 * UNIT


def target_items(baskets: Baskets) -> DataFrame:
    """(user_id, item_id): the items of each user's target basket."""
    targets = baskets.headers.where("is_target")
    return Baskets(targets, baskets.items).long().select("user_id", "item_id")


def recommend_popular(baskets: Baskets, k: int) -> DataFrame:
    """(user_id, item_id, rank): the ``k`` most frequent items, the same for every user."""
    ranked = F.sort_array(
        F.collect_list(F.struct((-F.col("frequency")).alias("minus_f"), "item_id"))
    )
    top = item_frequencies(baskets.items).orderBy(F.desc("frequency"), "item_id").limit(k)
    # k ids: a literal array, so that no join is needed
    best = [row["item_id"] for row in top.agg(ranked.alias("t")).first()["t"]]
    users = baskets.headers.where("is_target").select("user_id")
    return users.select(
        "user_id", F.posexplode(F.array(*[F.lit(i) for i in best])).alias("pos", "item_id")
    ).select("user_id", "item_id", (F.col("pos") + 1).alias("rank"))


class _Best:
    """The k best items so far of a few profiles, and scores not yet merged with them."""

    def __init__(self, profiles: np.ndarray, k: int):
        self.profiles, self.k = profiles, k
        self.rough = profiles.astype(np.float32)
        # rounding to floats, and sums of their products, move a score by less than this
        self.slack = 2 / UNIT + (profiles.shape[1] + 8) * 2.0**-23
        # best first; places without an item come last
        self.scores = np.full((len(profiles), k), NONE_YET)
        self.places = np.full((len(profiles), k), np.iinfo(np.int64).max)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def offer(self, unit: np.ndarray, rough: np.ndarray, places: np.ndarray, room: np.ndarray) -> None:
        """Look at a tile of items; only scores that may reach the k-th best are made exactly.

        ``rough`` are the vectors as floats, a column each; ``room`` is for their products.
        """
        width = -(-len(places) // STRETCH) * STRETCH
        product = room[: len(self.rough) * width].reshape(-1, width)
        product[:, len(places) :] = -np.inf
        np.matmul(self.rough, rough, out=product[:, : len(places)])
        floor = self.scores[:, -1] / UNIT
        if len(places) > self.k and floor.min() < -1.5:
            ranked = np.partition(product[:, : len(places)], -self.k, axis=1)[:, -self.k]
            floor = np.maximum(floor, ranked - self.slack)
        # floats are compared with floats, so the bound is rounded down
        bound = np.nextafter((floor - self.slack).astype(np.float32), np.float32(-np.inf))
        stretches = product.reshape(-1, STRETCH)
        high = np.flatnonzero(stretches.max(axis=1) >= np.repeat(bound, width // STRETCH))
        owner, start = np.divmod(high * STRETCH, width)
        at, within = np.divmod(np.flatnonzero(stretches[high] >= bound[owner, None]), STRETCH)
        row, column = owner[at], start[at] + within
        for first in range(0, len(row), PAIRS_AT_ONCE):
            some, chosen = row[first : first + PAIRS_AT_ONCE], column[first : first + PAIRS_AT_ONCE]
            exact = np.einsum("ij,ij->i", self.profiles[some], unit[chosen])
            # equal vectors must tie exactly, whatever block they are in
            self.waiting.append((some, np.rint(exact * UNIT).astype(np.int64), places[chosen]))
            self.n_waiting += len(some)
        if self.n_waiting >= self.scores.size:
            self.merge()

    def merge(self) -> None:
        rows = np.repeat(np.arange(len(self.scores)), self.k)
        row, near, places = (
            np.concatenate(c) for c in zip((rows, self.scores.ravel(), self.places.ravel()), *self.waiting)
        )
        # one number sorts by row and score; ids matter where scores are equal
        key = row * 4 * UNIT + (UNIT + UNIT // 2 - near)
        order = np.argsort(key)
        known = near[order] > NONE_YET
        if ((np.diff(key[order]) == 0) & known[1:]).any():
            order = np.lexsort((places, key))
        counts = np.bincount(row, minlength=len(self.scores))
        chosen = order[(np.cumsum(counts) - counts)[:, None] + np.arange(self.k)]
        self.scores, self.places = near[chosen], places[chosen]
        self.waiting, self.n_waiting = [], 0


def _best_of_cell(k: int, ranked: bool = False):
    """For one block of items and one of profiles: the k best items of each profile.

    Items come in tiles. Only scores that reach a profile's k-th best of the tiles before
    are looked at, so a tile costs little more than its product, which is of floats; what
    may reach the best is then scored in doubles. ``ranked`` gives places from 1 on instead
    of scores, where the block has all items.
    """
    last, kind = ("rank", pa.int32()) if ranked else ("score", pa.float64())

    def best(items: pa.Table, users: pa.Table) -> pa.Table:
        names = ["user_id", "item_id", last]
        if not (items.num_rows and users.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), kind)], names=names)
        # places by id, null first, as equal scores have it
        order = pa.compute.sort_indices(items["item_id"], null_placement="at_start")
        ids = items["item_id"].take(order).combine_chunks()
        places = np.empty(len(ids), np.int64)
        places[order.to_numpy()] = np.arange(len(ids))
        parts = [users.slice(at, USERS_AT_ONCE) for at in range(0, users.num_rows, USERS_AT_ONCE)]
        states = [_Best(unit_rows(_dense(part["profile"], part.num_rows)), min(k, len(ids))) for part in parts]
        room = np.empty(min(USERS_AT_ONCE, users.num_rows) * -(-ITEMS_AT_ONCE // STRETCH) * STRETCH, np.float32)
        for at in range(0, len(ids), ITEMS_AT_ONCE):
            part = items.slice(at, ITEMS_AT_ONCE)
            unit = unit_rows(_dense(part["v"], part.num_rows).astype(float))
            rough = np.ascontiguousarray(unit.T, np.float32)
            for state in states:
                state.offer(unit, rough, places[at : at + ITEMS_AT_ONCE], room)
        user_ids = users["user_id"].combine_chunks()
        own = user_ids.dictionary_encode(null_encoding="encode")
        repeated = ranked and len(own.dictionary) < len(own)
        found: list[tuple[np.ndarray, ...]] = []
        for n, state in enumerate(states):
            state.merge()
            row, at = np.nonzero(state.scores > NONE_YET)
            scores = state.scores[row, at] if repeated or not ranked else at + 1
            found.append((row + n * USERS_AT_ONCE, state.places[row, at], scores))
        row, place, value = (np.concatenate(c) for c in zip(*found))
        if repeated:
            # a user who comes more than once has one list
            code = own.indices.to_numpy()[row]
            order = np.lexsort((place, -value, code))
            counts = np.bincount(code)
            at = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
            order, value = order[at < k], at[at < k] + 1
            row, place = row[order], place[order]
        value = value if ranked else value / UNIT
        columns = [user_ids.take(pa.array(row)), ids.take(pa.array(place)), pa.array(value).cast(kind)]
        return pa.table([c.cast(pa.int64()) for c in columns[:2]] + columns[2:], names=names)

    return best


def _dense(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy().reshape(rows, -1)


def recommend_nearest(
    profiles: DataFrame,
    vectors: DataFrame,
    k: int,
    col: str = "embedding",
    block_bytes: int | None = None,
) -> DataFrame:
    """(user_id, item_id, rank): the ``k`` items with highest cosine to the profile.

    Items and profiles are cut into blocks of about ``block_bytes`` (by default
    ``ITEM_BLOCK_BYTES`` and ``BLOCK_BYTES``), and every block of items meets every block of
    profiles on an executor. Nothing goes through the driver or a broadcast. Where one block
    has all items a cell ranks them itself; otherwise it keeps k items per profile, and a
    rank filter cuts a user's lists before they are merged. Items without a vector are never
    recommended and users without a profile get no list; equal scores go by item id.
    """
    spark = vectors.sparkSession
    rows, width = vectors.agg(F.count(col), F.max(F.size(col))).first()
    profiles = written(
        profiles.where("profile IS NOT NULL").select("user_id", F.col("profile").cast("array<double>").alias("profile")),
        "profiles",
    )
    n_users = profiles.count()
    # floats travel as they are, half as many bytes
    element = "array<float>" if dict(vectors.dtypes)[col] == "array<float>" else "array<double>"
    per_block = max(1, (block_bytes or BLOCK_BYTES) // (8 * (width or 1)))
    item_bytes = (4 if element == "array<float>" else 8) * (width or 1)
    item_blocks = max(1, -(-rows // max(1, (block_bytes or ITEM_BLOCK_BYTES) // item_bytes)))
    # blocks of profiles are small enough to occupy every core
    per_core = -(-n_users // spark.sparkContext.defaultParallelism)
    user_blocks = max(1, -(-n_users // max(1, min(per_block, per_core))))

    def block_of(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    cell = ["item_block", "user_block"]
    items = vectors.where(F.col(col).isNotNull()).select(
        block_of("item_id", item_blocks).alias("item_block"), every(user_blocks).alias("user_block"),
        F.col("item_id").cast("bigint").alias("item_id"), F.col(col).cast(element).alias("v"),
    )
    users = profiles.select(
        every(item_blocks).alias("item_block"), block_of("user_id", user_blocks).alias("user_block"),
        F.col("user_id").cast("bigint").alias("user_id"), "profile",
    )
    cells = items.groupBy(*cell).cogroup(users.groupBy(*cell))
    if item_blocks == 1:
        return cells.applyInArrow(_best_of_cell(k, ranked=True), "user_id bigint, item_id bigint, rank int")
    found = cells.applyInArrow(_best_of_cell(k), "user_id bigint, item_id bigint, score double")
    order = W.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("user_id", "item_id", "rank")


def _user_hits(recommended: DataFrame, relevant: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Per user with relevant items: their number, hits and gain at each cutoff, first hit."""
    top = max(cutoffs)
    marked = relevant.select("user_id", "item_id").join(
        recommended.where(F.col("rank") <= top).select("user_id", "item_id", "rank"),
        ["user_id", "item_id"],
        "left",
    )
    gain = 1 / F.log2(F.col("rank") + 1.0)
    aggs = [F.count("*").alias("n_relevant"), F.min("rank").alias("first_hit")]
    for k in cutoffs:
        inside = F.col("rank") <= k
        aggs += [
            F.count_if(inside).alias(f"hits_{k}"),
            F.coalesce(F.sum(F.when(inside, gain)), F.lit(0.0)).alias(f"dcg_{k}"),
        ]
    return marked.groupBy("user_id").agg(*aggs)


def ranking_metrics(
    recommended: DataFrame, relevant: DataFrame, cutoffs: list[int] = CUTOFFS
) -> DataFrame:
    """(k, precision, recall, hit, ndcg, mrr, samples): means over users with relevant items.

    ``recommended`` is (user_id, item_id, rank) and ``relevant`` distinct
    (user_id, item_id). The ideal gain has min(relevant, k) hits in front.
    """
    users = _user_hits(recommended, relevant, cutoffs)
    ideal_sums = np.cumsum(1 / np.log2(np.arange(2, max(cutoffs) + 2)))
    ideal = F.array(*[F.lit(float(x)) for x in ideal_sums])
    per_cutoff = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (F.col(f"hits_{k}") / k).alias("precision"),
                (F.col(f"hits_{k}") / F.col("n_relevant")).alias("recall"),
                (F.col(f"hits_{k}") > 0).cast("double").alias("hit"),
                (
                    F.col(f"dcg_{k}")
                    / F.get(ideal, F.least("n_relevant", F.lit(k)).cast("int") - 1)
                ).alias("ndcg"),
                F.when(F.col("first_hit") <= k, 1 / F.col("first_hit"))
                .otherwise(0.0)
                .alias("mrr"),
            )
            for k in cutoffs
        ]
    )
    return (
        users.select(F.explode(per_cutoff).alias("m"))
        .groupBy("m.k")
        .agg(
            *[F.avg(f"m.{name}").alias(name) for name in ("precision", "recall", "hit", "ndcg", "mrr")],
            F.count("*").alias("samples"),
        )
    )


def item_coverage(recommended: DataFrame, vocab_size: int) -> DataFrame:
    """One row: distinct recommended items over the vocabulary size."""
    return recommended.agg(
        F.countDistinct("item_id").alias("recommended_items"),
        (F.countDistinct("item_id") / F.lit(vocab_size)).alias("item_coverage"),
    )


def recommendation_entropy(recommended: DataFrame) -> DataFrame:
    """One row: entropy in bits of the recommended items' frequencies.

    From n and sum(c log c) alone, so one pass over the item counts is enough.
    """
    counts = recommended.groupBy("item_id").agg(F.count("*").alias("c"))
    total = F.sum("c")
    return counts.agg(
        (F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total).alias("recommendation_entropy")
    )


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    """One row: mean of 1/rank over (.., rank) rows."""
    return ranks.agg(F.avg(1 / F.col("rank")).alias("mrr"))
