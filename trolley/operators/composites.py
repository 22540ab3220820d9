"""Composite products: family centroids in the original and the reduced space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions.vectors import euclidean, mean_vector
from trolley.operators.linalg import SvdModel, project

MIN_MEMBERS = 2
INTER_FAMILIES = 50


def family_vectors(
    members: DataFrame, vectors: DataFrame, id_map: DataFrame | None = None
) -> DataFrame:
    """Members with a vector (item_id, embedding) and, through ``id_map``, their vector id.

    ``id_map`` is (product_id, item_id); by default the two ids are the same.
    Members without a vector drop out.
    """
    if id_map is None:
        known = members.withColumn("item_id", F.col("product_id").try_cast("bigint"))
    else:
        known = members.join(id_map, "product_id")
    return known.select(
        "family_id", "member_no", "product_id", "product_name", "item_id"
    ).join(vectors.select("item_id", "embedding"), "item_id")


def composites(
    families: DataFrame, member_vectors: DataFrame, model: SvdModel | None = None
) -> DataFrame:
    """(family_id, family_name, size, avg_similarity, composite_original[, composite_reduced]).

    Families with fewer than two members that have a vector give no composite.
    """
    centres = (
        member_vectors.groupBy("family_id")
        .agg(F.count("*").alias("size"), mean_vector(F.col("embedding")).alias("composite_original"))
        .where(F.col("size") >= MIN_MEMBERS)
    )
    out = families.select("family_id", "family_name", "avg_similarity").join(centres, "family_id")
    if model is None:
        return out
    return project(out, model, "composite_original", scaled=True).withColumnRenamed(
        "reduced", "composite_reduced"
    )


def member_reductions(
    member_vectors: DataFrame, composite: DataFrame, model: SvdModel
) -> DataFrame:
    """Members of composites with their own reduced vector, next to the composite's."""
    reduced = project(member_vectors, model, scaled=True).withColumnRenamed(
        "reduced", "component_reduced"
    )
    return reduced.join(composite.select("family_id", "composite_reduced"), "family_id")


def intra_distances(members: DataFrame, member_col: str, centre_col: str) -> DataFrame:
    """Distance of each member to its composite."""
    return members.select(
        "family_id", euclidean(F.col(member_col), F.col(centre_col)).alias("distance")
    )


def inter_distances(
    composite: DataFrame, vector_col: str, first: int = INTER_FAMILIES
) -> DataFrame:
    """Pairwise distances among the ``first`` composites in family order.

    The sample is the feature: ``first`` rows become one short array whose pairs
    are read off in place, without a join.
    """
    few = composite.orderBy("family_id").limit(first).select("family_id", vector_col)
    listed = few.agg(
        F.sort_array(F.collect_list(F.struct("family_id", F.col(vector_col).alias("v")))).alias("c")
    )
    left = listed.select("c", F.posexplode("c").alias("k", "one"))
    pairs = left.select(
        "one", F.explode(F.slice("c", F.col("k") + 2, F.size("c"))).alias("other")
    )
    return pairs.select(
        F.col("one.family_id").alias("family_a"),
        F.col("other.family_id").alias("family_b"),
        euclidean(F.col("one.v"), F.col("other.v")).alias("distance"),
    )


def mean_square_distance(composite: DataFrame, vector_col: str) -> DataFrame:
    """One row: composites, and the mean squared distance over all their pairs.

    It follows from sums per dimension, so no pair is formed:
    2n / (n - 1) * (mean of squared lengths - squared length of the mean).
    """
    single = composite.select(F.posexplode(vector_col).alias("d", "x"))
    sums = single.groupBy("d").agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    n = F.max("n")
    gap = F.sum(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))
    return sums.agg(
        F.coalesce(n, F.lit(0)).alias("composites"),
        F.when(n > 1, gap * 2 * n / (n - 1)).alias("mean_square_distance"),
    )


def separation(intra: DataFrame, inter: DataFrame) -> DataFrame:
    """One row: mean intra and inter distances, their ratio and a verdict."""
    both = intra.select("distance", F.lit(True).alias("inside")).unionByName(
        inter.select("distance", F.lit(False).alias("inside"))
    )
    means = both.agg(
        F.avg(F.when(F.col("inside"), F.col("distance"))).alias("avg_intra_distance"),
        F.avg(F.when(~F.col("inside"), F.col("distance"))).alias("avg_inter_distance"),
    )
    ratio = F.when(
        F.col("avg_intra_distance") > 0,
        F.col("avg_inter_distance") / F.col("avg_intra_distance"),
    ).otherwise(0.0)
    return means.withColumn("separation_ratio", ratio).withColumn(
        "verdict",
        F.when(F.col("separation_ratio") > 1.5, "good")
        .when(F.col("separation_ratio") > 1.2, "moderate")
        .otherwise("poor"),
    )


def composite_sizes(composite: DataFrame) -> DataFrame:
    """One row: number of composites, mean, largest and smallest size."""
    return composite.agg(
        F.count("*").alias("composites"),
        F.avg("size").alias("avg_size"),
        F.max("size").alias("max_size"),
        F.min("size").alias("min_size"),
    )


def largest_composites(composite: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` composites with most members."""
    return composite.orderBy(F.desc("size"), "family_id").limit(n)
