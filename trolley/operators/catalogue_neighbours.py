"""Exact nearest neighbours of every row of a sparse catalogue, without a sample.

Equal vectors are one class, so copies cost nothing. A few candidates per class from its
rarest terms give a score that its k best reach at least. Whatever reaches that score
shares one of the class's leading terms, in order of rarity: what the other terms can add
is at most their norm. So only leading terms are joined to the postings, pairs that cannot
reach the score fall out by their partial sums, and the others are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.operators.skew import attach_by_key
from trolley.storage import spread, written

# first candidates: so many rows of each of so many of the rarest terms of a class
PROBED_ROWS, PROBED_TERMS = 32, 4
# leading terms and postings of one index meet in cells of at most this many rows a side
CELL_ROWS = 2_000
# digits of a score that count for the order, and what rounding may hide
DIGITS, SLACK = 9, 1e-8
_WEIGHT_DIGITS = 12


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cls) and (cls, n, vec): rows by equal vectors; a class is named by its least id.

    ``vec`` is the sparse row in index order, with weights rounded far below the scores.
    """
    entry = F.struct("idx", F.round("weight", _WEIGHT_DIGITS).alias("weight"))
    rows = written(
        vectors.where("weight <> 0").groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("vec")),
        "catalogue-rows",
    )
    classes = written(
        rows.groupBy("vec").agg(F.min("id").alias("cls"), F.count("*").alias("n")), "catalogue-classes"
    )
    members = attach_by_key(rows, classes, ["vec"], "n", cheap=True).select("id", "cls")
    return written(members, "catalogue-members"), classes


def _ordered_terms(classes: DataFrame) -> DataFrame:
    """(cls, idx, weight, place, rest): each class's terms from the rarest on.

    ``place`` counts from 1; ``rest`` is the norm of this term and all after it.
    """
    entries = classes.select("cls", F.explode("vec").alias("e")).select("cls", "e.idx", "e.weight")
    known = entries.groupBy("idx").agg(F.count("*").alias("df"))
    entries = attach_by_key(entries, known, ["idx"], "df")
    # a vector has at most as many terms as the vocabulary
    order = W.partitionBy("cls").orderBy("df", "idx")
    back = W.partitionBy("cls").orderBy(F.desc("df"), F.desc("idx"))
    return entries.select(
        "cls", "idx", "weight", "df",
        F.row_number().over(order).alias("place"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(back)).alias("rest"),
    )


def _dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scalar products of the two sparse rows of each pair."""
    for batch in batches:
        one, two = batch.column("vec"), batch.column("other_vec")
        keys, weights, owner = [], [], None
        width = 1
        for side in (one, two):
            flat = side.flatten()
            keys.append(flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64))
            weights.append(flat.field(1).to_numpy(zero_copy_only=False))
            if len(keys[-1]):
                width = max(width, int(keys[-1].max()) + 1)
        for i, side in enumerate((one, two)):
            number = np.repeat(np.arange(batch.num_rows), side.value_lengths().to_numpy(zero_copy_only=False))
            keys[i] = number * width + keys[i]
            owner = number if i == 0 else owner
        at = np.minimum(np.searchsorted(keys[1], keys[0]), max(len(keys[1]) - 1, 0))
        shared = keys[1][at] == keys[0] if len(keys[1]) else np.zeros(len(keys[0]), bool)
        products = weights[0][shared] * weights[1][at[shared]]
        scores = np.bincount(owner[shared], products, batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("cls"), batch.column("other"), pa.array(np.round(scores, DIGITS))],
            names=["cls", "other", "score"],
        )


def _scored(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, other, score) of pairs (cls, other)."""
    vecs = classes.select("cls", "vec")
    full = pairs.select("cls", "other").join(vecs, "cls").join(
        vecs.select(F.col("cls").alias("other"), F.col("vec").alias("other_vec")), "other"
    )
    return full.select("cls", "other", "vec", "other_vec").mapInArrow(_dot, "cls bigint, other bigint, score double")


def _least_scores(terms: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cls, least): a score that the k best neighbours of a class reach at least.

    A bounded number of rows of each term is looked at. That can only lower the bound;
    what is found in the end does not depend on it.
    """
    few = terms.select("idx", F.col("cls").alias("other"), F.xxhash64("cls", "idx").alias("h"))
    few = few.withColumn("no", F.row_number().over(W.partitionBy("idx").orderBy("h", "other")))
    few = few.where(F.col("no") <= PROBED_ROWS).groupBy("idx").agg(F.collect_list("other").alias("others"))
    asked = terms.where("df > 1").withColumn(
        "no", F.row_number().over(W.partitionBy("cls").orderBy("place"))
    ).where(F.col("no") <= PROBED_TERMS)
    demand = asked.groupBy("idx").agg(F.count("*").alias("rows"))
    pairs = (
        attach_by_key(asked.select("cls", "idx"), few.join(demand, "idx"), ["idx"], "rows")
        .select("cls", F.explode("others").alias("other"))
        .where("cls <> other")
        .distinct()
    )
    # other members of the class have score 1 and make up for as many others
    missing = F.greatest(F.lit(k) - (F.col("n") - 1), F.lit(0))
    # at most PROBED_ROWS * PROBED_TERMS scores a class
    best = _scored(pairs, classes).groupBy("cls").agg(F.sort_array(F.collect_list("score"), False).alias("best"))
    found = F.coalesce(F.get("best", (missing - 1).cast("int")), F.lit(0.0))
    return classes.select("cls", "n").join(best, "cls", "left").select(
        "cls", F.when(missing == 0, F.lit(1.0)).otherwise(found).alias("least")
    )


def _meeting(leading: DataFrame, postings: DataFrame) -> DataFrame:
    """Leading terms joined to the postings of their index, hot indexes in a grid of cells."""

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("idx").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name), F.count("*").alias(f"{name}_rows"))

    grid = written(parts(leading, "a").join(parts(postings, "b"), "idx"), "catalogue-grid")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        sizes = grid.select("idx", "a", "b", f"{own}_rows")
        spread_over = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_cell")
        at = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(f"{own}_cell")
        kept = [c for c in rows.columns if c != "idx"]
        return attach_by_key(rows, sizes, ["idx"], f"{own}_rows", cheap=True).select("idx", *kept, at, spread_over)

    return dealt(leading, "cls", "a", "b").join(dealt(postings, "other", "b", "a"), ["idx", "a_cell", "b_cell"])


def _candidates(terms: DataFrame, least: DataFrame) -> DataFrame:
    """(cls, other): pairs of classes that may reach the score the first one asks for."""
    asked = F.greatest(F.col("least") - F.lit(SLACK), F.lit(0.0))
    bounded = written(terms.join(least.select("cls", asked.alias("asked")), "cls"), "catalogue-terms")
    leading = bounded.where(F.col("rest") >= F.col("asked"))
    # what the terms behind the leading ones can add at most
    behind = bounded.where(F.col("rest") < F.col("asked")).groupBy("cls").agg(F.max("rest").alias("behind"))
    postings = terms.select("idx", F.col("cls").alias("other"), F.col("weight").alias("other_weight"))
    both = F.col("weight") * F.col("other_weight")
    met = (
        _meeting(leading.select("idx", "cls", "weight"), postings)
        .where("cls <> other")
        .groupBy("cls", "other")
        .agg(F.sum(both).alias("sure"), F.sum(F.col("other_weight") * F.col("other_weight")).alias("used"))
    )
    bounds = least.select("cls", asked.alias("asked")).join(behind, "cls", "left")
    left = F.sqrt(F.greatest(F.lit(1.0 + SLACK) - F.col("used"), F.lit(0.0)))
    most = F.col("sure") + F.coalesce("behind", F.lit(0.0)) * left
    return met.join(bounds, "cls").where(most + SLACK >= F.col("asked")).select("cls", "other")


def catalogue_neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """(id, rank, neighbour_id, score): the ``k`` most similar rows of every row.

    ``vectors`` are sparse rows (id, idx, weight) of unit length with bigint ids and
    weights that are not negative. Scores are cosines to nine digits, ties go by id, a row
    is not its own neighbour. Rows without a common term are no neighbours, so a row may
    have fewer than ``k``; a row without weights has none and is nobody's.
    """
    members, classes = _classes(vectors)
    terms = written(_ordered_terms(classes), "catalogue-terms")
    least = written(_least_scores(terms, classes, k), "catalogue-bounds")
    pairs = written(_candidates(terms, least), "catalogue-pairs")
    scored = _scored(spread(pairs), classes).where("score > 0")
    own = classes.select("cls", F.col("cls").alias("other"), F.lit(1.0).alias("score"))

    # a class needs at most k + 1 rows of another one, or of itself
    first = W.partitionBy("cls").orderBy("id")
    shown = members.withColumn("no", F.row_number().over(first)).where(F.col("no") <= k + 1)
    order = F.struct((-F.col("score")).alias("minus_score"), F.col("id"))
    listed = scored.unionByName(own).join(shown.select(F.col("cls").alias("other"), "id"), "other")
    best = listed.withColumn("no", F.row_number().over(W.partitionBy("cls").orderBy(F.desc("score"), "id")))
    best = best.where(F.col("no") <= k + 1).groupBy("cls").agg(F.sort_array(F.collect_list(order)).alias("best"))
    lists = best.join(classes.select("cls", "n"), "cls")

    def others(best: Column) -> Column:
        return F.slice(F.filter(best, lambda e: e["id"] != F.col("id")), 1, k)

    return attach_by_key(members, lists, ["cls"], "n").select("id", F.posexplode(others(F.col("best"))).alias("at", "e")).select(
        "id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("neighbour_id"), (-F.col("e.minus_score")).alias("score")
    )
