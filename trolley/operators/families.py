"""Greedy fuzzy product families, computed in parallel with the sequential result.

The sequential rule over the sorted catalogue: the first unused product becomes
an anchor and looks at up to ``window`` following products; it stops at the first
used one or when the family is full, and takes each similar, compatible product.

Why that splits. An anchor that sees no used product ahead ("free") claims the
first max_size - 1 matching products of its window. No other product behind its
last claim is touched by it, and an anchor between two of its claims must stop at
the next claim. So the product after the last claim is again free, and free
anchors form a chain a -> next(a) with next(a) - a <= window + 1. Blocks of the
catalogue are therefore summarised by where the chain leaves them for each of
the window + 1 places it can enter. Composing those summaries gives every block
its entry point, and then all blocks are resolved independently. Runs of equal
names, however long, are cut at block borders like anything else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions.similarity import (
    JACCARD_WORDS,
    Metric,
    department_bits,
    departments_mix,
    first_conflict_bits,
    second_conflict_bits,
)
from trolley.functions.text import clean_for_comparison, title_case
from trolley.operators.catalogue import with_key_terms
from trolley.operators.position import add_offsets, with_positions
from trolley.storage import balanced, spread, written

WINDOW = 100
TILE_ROWS = 2_000
BLOCK_ROWS = 50_000
FANOUT = 1_000
BROADCAST_BLOCKS = 500_000


class Families(NamedTuple):
    """``families``: one row each; ``members``: family_id, member_no and product columns."""

    families: DataFrame
    members: DataFrame


def sort_products(products: DataFrame, metric: Metric = JACCARD_WORDS) -> DataFrame:
    """Products with key terms, their position in sort order and comparison columns.

    The text work is spread first, as a catalogue may be one small file, and its result is
    written, as range partitioning reads its input twice.
    """
    named = with_key_terms(balanced(products)[0])
    prepared = named.withColumns(
        {
            "cmp": metric.prepare(clean_for_comparison(F.col("product_name"))),
            "bits1": first_conflict_bits(F.col("product_name")),
            "bits2": second_conflict_bits(F.col("product_name")),
        }
    )
    return with_positions(written(prepared, "prepared"), ["sort_key", "product_id"], "pos")


def _tile_matches(
    metric: Metric, threshold: int, window: int, tile_rows: int
) -> Callable[[pa.Table], pa.Table]:
    """Per tile: each of its rows that has matches, with them and their scores."""

    def matches(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos = rows["pos"].to_numpy()
        apart = {c: rows[c].to_numpy() for c in ("bits1", "bits2", "left", "right")}
        own = int(np.searchsorted(pos, (rows["tile"][0].as_py() + 1) * tile_rows))
        anchors, found, scores = [], [], []
        for first, score in metric.band(rows["cmp"].combine_chunks(), window):
            mine = slice(first, first + score.shape[0])
            others = slice(first, first + score.shape[1])
            gap = pos[None, others] - pos[mine, None]
            clash = (apart["bits1"][mine, None] & apart["bits2"][None, others]) | (
                apart["left"][mine, None] & apart["right"][None, others]
            ) | (apart["right"][mine, None] & apart["left"][None, others])
            hit = (gap > 0) & (gap <= window) & (clash == 0) & (score >= threshold)
            hit[max(own - first, 0) :] = False
            i, j = np.nonzero(hit)
            anchors.append(pos[mine][i])
            found.append(pos[others][j])
            scores.append(score[i, j])
        i = np.concatenate(anchors)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        cuts = pa.array(np.append(starts, len(i)).astype(np.int32))
        return pa.table(
            {
                "i": pa.array(i[starts], pa.int64()),
                "js": pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(found), pa.int64())),
                "scores": pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(scores), pa.int32())),
            }
        )

    return matches


def candidate_lists(
    placed: DataFrame,
    metric: Metric = JACCARD_WORDS,
    threshold: int = 80,
    window: int = WINDOW,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(i, js, scores): the pairs of ``candidate_pairs``, one row per product that has any.

    A metric that scores bands does so in tiles of consecutive products, each lent the
    ``window`` products after it; no pair is a row.
    """
    if metric.band is None:
        pairs = _joined_pairs(placed, metric, threshold, window).groupBy("i")
        listed = pairs.agg(F.sort_array(F.collect_list(F.struct("j", "score"))).alias("m"))
        return listed.select("i", F.col("m.j").alias("js"), F.col("m.score").alias("scores"))
    tile_rows = max(tile_rows, window)
    tile = F.expr(f"pos div {tile_rows}")
    near_start = (F.col("pos") % tile_rows < window) & (tile > 0)
    left, right = department_bits(F.col("department"))
    lent = placed.select(
        "pos",
        F.explode(F.when(near_start, F.array(tile, tile - 1)).otherwise(F.array(tile))).alias("tile"),
        "cmp",
        "bits1",
        "bits2",
        left.alias("left"),
        right.alias("right"),
    )
    # fixed partitions keep comparisons spread
    return spread(lent, "tile").groupBy("tile").applyInArrow(
        _tile_matches(metric, threshold, window, tile_rows),
        "i bigint, js array<bigint>, scores array<int>",
    )


def candidate_pairs(
    placed: DataFrame,
    metric: Metric = JACCARD_WORDS,
    threshold: int = 80,
    window: int = WINDOW,
) -> DataFrame:
    """(i, j, score): compatible products at most ``window`` apart reaching the threshold."""
    if metric.band is None:
        return _joined_pairs(placed, metric, threshold, window)
    listed = candidate_lists(placed, metric, threshold, window)
    return listed.select("i", F.explode(F.arrays_zip("js", "scores")).alias("m")).select(
        "i", F.col("m.js").alias("j"), F.col("m.scores").alias("score")
    )


def _joined_pairs(placed: DataFrame, metric: Metric, threshold: int, window: int) -> DataFrame:
    """A band join as an equi-join: each left row meets the buckets of width
    ``window`` its band can touch, so every bucket holds at most ``window`` rows.
    """
    right = placed.select(
        F.col("pos").alias("j"),
        F.expr(f"pos div {window}").alias("bucket"),
        F.col("cmp").alias("cmp2"),
        F.col("department").alias("dept2"),
        "bits2",
    )
    first = F.expr(f"pos div {window}")
    left = placed.select(
        F.col("pos").alias("i"),
        F.explode(F.array(first, first + 1)).alias("bucket"),
        F.col("cmp").alias("cmp1"),
        F.col("department").alias("dept1"),
        "bits1",
    )
    # the join needs both sides by bucket anyway; fixed partitions keep comparisons spread
    near = spread(left, "bucket").join(spread(right, "bucket"), "bucket").where(
        (F.col("j") > F.col("i"))
        & (F.col("j") <= F.col("i") + window)
        & (F.col("bits1").bitwiseAND(F.col("bits2")) == 0)
        & departments_mix(F.col("dept1"), F.col("dept2"))
    )
    # most pairs differ too much in size to reach the threshold
    near = near.where(metric.at_most(F.col("cmp1"), F.col("cmp2")) >= threshold)
    return near.withColumn("score", metric.score(F.col("cmp1"), F.col("cmp2"))).where(
        F.col("score") >= threshold
    ).select("i", "j", "score")


def _chain_links(placed: DataFrame, pairs: DataFrame, max_size: int, block_rows: int) -> DataFrame:
    """(block, pos, matches, next): the first max_size - 1 matches of each position."""
    listed = pairs
    if "js" not in pairs.columns:
        listed = pairs.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("js"))
    nearest = listed.select("i", F.slice("js", 1, max_size - 1).alias("matches"))
    matches = F.coalesce("matches", F.array().cast("array<bigint>"))
    return (
        placed.select("pos")
        # the size of lists is not known ahead, and many are too large to be shared
        .join(nearest.withColumnRenamed("i", "pos").hint("merge"), "pos", "left")
        .withColumn("matches", matches)
        .withColumn(
            "next", F.coalesce(F.try_element_at("matches", F.lit(-1)), F.col("pos")) + 1
        )
        .withColumn("block", F.expr(f"pos div {block_rows}"))
    )


def _block_exits(block_rows: int, window: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per block: where the chain leaves it, for each of the places it can enter."""

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        jump = rows.sort_values("pos")["next"].to_numpy() - block * block_rows
        size = len(jump)
        leave = np.arange(block_rows + window + 1)
        for at in range(size - 1, -1, -1):
            leave[at] = leave[jump[at]] if jump[at] < block_rows else jump[at]
        # rows past a short last block do not exist; leaving it is never asked for
        entry = np.maximum(leave[: window + 1] - block_rows, 0).tolist()
        return pd.DataFrame({"block": [block], "exits": [entry]})

    return exits


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    """Join the summaries of consecutive blocks into one."""
    ordered = rows.sort_values("block")
    total = np.arange(len(ordered["exits"].iloc[0]))
    for exits in ordered["exits"]:
        total = np.asarray(exits)[total]
    return pd.DataFrame({"block": [int(rows["parent"].iloc[0])], "exits": [total.tolist()]})


def _entries_below(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry points of a group's blocks, given the entry point of the group."""
    ordered = rows.sort_values("block")
    at = int(ordered["entry"].iloc[0])
    entries = []
    for exits in ordered["exits"]:
        entries.append(at)
        at = int(exits[at])
    return pd.DataFrame({"block": ordered["block"].to_numpy(), "entry": entries})


def _block_entries(exits: DataFrame, n_blocks: int, fanout: int) -> DataFrame:
    """(block, entry) for every block, the chain starting at the very first row.

    At most ``fanout`` summaries ever reach the driver; more are composed level
    by level on the executors.
    """
    if n_blocks <= fanout:
        rows = exits.orderBy("block").toPandas()
        rows["entry"] = 0
        return exits.sparkSession.createDataFrame(
            _entries_below(rows), "block bigint, entry bigint"
        )
    grouped = exits.withColumn("parent", F.expr(f"block div {fanout}"))
    parents = grouped.groupBy("parent").applyInPandas(
        _compose, "block bigint, exits array<bigint>"
    )
    above = _block_entries(
        written(parents, "chain-levels"), -(-n_blocks // fanout), fanout
    )
    return (
        grouped.join(above.withColumnRenamed("block", "parent"), "parent")
        .groupBy("parent")
        .applyInPandas(_entries_below, "block bigint, entry bigint")
    )


def _claims(start: int, limit: int, matches: dict[int, list[int]], max_size: int) -> Iterator:
    """Anchors and members of the rows in [start, limit), all free at the start."""
    at = start
    while at < limit:
        members = [j for j in matches[at] if j < limit][: max_size - 1]
        yield at, members
        bounds = [at, *members]
        for low, high in zip(bounds, bounds[1:]):
            yield from _claims(low + 1, high, matches, max_size)
        at = bounds[-1] + 1


def _resolve(
    block_rows: int, max_size: int, min_size: int
) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per block: the families whose free anchor lies in the block."""

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["home"].iloc[0])
        end = min((block + 1) * block_rows, int(rows["pos"].max()) + 1)
        matches = {int(p): [int(j) for j in m] for p, m in zip(rows["pos"], rows["matches"])}
        at = block * block_rows + int(rows["entry"].iloc[0])
        found = []
        while at < end:
            last = matches[at][-1] if matches[at] else at
            found += [
                (anchor, members)
                for anchor, members in _claims(at, last + 1, matches, max_size)
                if len(members) + 1 >= min_size
            ]
            at = last + 1
        found.sort(key=lambda family: family[0])
        flat = [
            (block, index, number, pos)
            for index, (anchor, members) in enumerate(found)
            for number, pos in enumerate([anchor, *members])
        ]
        return pd.DataFrame(flat, columns=["block", "family_index", "member_no", "pos"])

    return resolve


def assign_families(
    placed: DataFrame,
    pairs: DataFrame,
    min_size: int = 2,
    max_size: int = 15,
    window: int = WINDOW,
    block_rows: int = BLOCK_ROWS,
    fanout: int = FANOUT,
) -> DataFrame:
    """(family_id, member_no, pos): the families of the sequential rule, numbered by anchor.

    ``pairs`` are rows (i, j), or lists (i, js) with the ``js`` in order.
    """
    if block_rows <= window:
        raise ValueError("a block must be longer than the look-ahead window")
    links = written(_chain_links(placed, pairs, max_size, block_rows), "chain-links")
    last = links.agg(F.max("pos")).first()[0]
    n_blocks = 0 if last is None else last // block_rows + 1
    exits = written(
        links.select("block", "pos", "next")
        .groupBy("block")
        .applyInPandas(_block_exits(block_rows, window), "block bigint, exits array<bigint>"),
        "chain-exits",
    )
    entries = _block_entries(exits, n_blocks, fanout)
    # a family may reach up to ``window`` rows into the next block: lend it those rows
    near_start = (F.col("pos") % block_rows < window) & (F.col("block") > 0)
    homes = F.when(near_start, F.array(F.col("block"), F.col("block") - 1)).otherwise(
        F.array(F.col("block"))
    )
    lent = links.select("pos", "matches", F.explode(homes).alias("home"))
    resolved = written(
        lent.join(entries.withColumnRenamed("block", "home"), "home")
        .groupBy("home")
        .applyInPandas(
            _resolve(block_rows, max_size, min_size),
            "block bigint, family_index bigint, member_no int, pos bigint",
        ),
        "family-members",
    )
    numbered = add_offsets(
        resolved.where("member_no = 0"), "block", "family_index", "family_id",
        broadcast=n_blocks <= BROADCAST_BLOCKS,
    ).select("block", "family_index", "family_id")
    return resolved.join(numbered, ["block", "family_index"]).select(
        "family_id", "member_no", "pos"
    )


def family_members(assigned: DataFrame, placed: DataFrame) -> DataFrame:
    """Family membership with the product columns."""
    return assigned.join(placed, "pos").select(
        "family_id",
        "member_no",
        "pos",
        "product_id",
        "product_name",
        "department",
        "aisle",
        "key_terms",
        "cmp",
    )


def family_similarity(members: DataFrame, metric: Metric = JACCARD_WORDS) -> DataFrame:
    """(family_id, avg_similarity): mean over all member pairs; 100 for a lone member.

    A family has at most window + 1 members, so its pairs come from one small array.
    """
    grouped = members.groupBy("family_id").agg(
        F.sort_array(F.collect_list(F.struct("member_no", "cmp"))).alias("m")
    )
    firsts = grouped.select("family_id", "m", F.posexplode("m").alias("k", "one"))
    pairs = firsts.select(
        "family_id",
        F.col("one.cmp").alias("a"),
        F.explode_outer(F.slice("m", F.col("k") + 2, F.size("m"))).alias("other"),
    )
    score = F.when(
        F.col("other").isNotNull(), metric.score(F.col("a"), F.col("other.cmp"))
    )
    return (
        pairs.withColumn("score", score)
        .groupBy("family_id")
        .agg(F.coalesce(F.avg("score"), F.lit(100.0)).alias("avg_similarity"))
    )


def common_terms(members: DataFrame) -> DataFrame:
    """(family_id, terms): of the three most frequent key terms, those seen twice or more."""
    terms = members.select(
        "family_id", "member_no", F.posexplode("key_terms").alias("term_no", "term")
    )
    counted = terms.groupBy("family_id", "term").agg(
        F.count("*").alias("n"), F.min(F.struct("member_no", "term_no")).alias("first_seen")
    )
    ranked = F.slice(
        F.sort_array(
            F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "first_seen", "term"))
        ),
        1,
        3,
    )
    return counted.groupBy("family_id").agg(
        F.filter(ranked, lambda t: t["minus_n"] < -1).getField("term").alias("terms")
    )


def summarise_families(members: DataFrame, metric: Metric = JACCARD_WORDS) -> DataFrame:
    """One row per family: name, size, representative, departments, aisles, similarity."""
    anchor = F.col("member_no") == 0
    basics = members.groupBy("family_id").agg(
        F.count("*").alias("size"),
        F.max(F.when(anchor, F.col("product_name"))).alias("representative_product"),
        F.max(F.when(anchor, F.get("key_terms", F.lit(0)))).alias("_lead_term"),
        F.sort_array(F.collect_set("department")).alias("departments"),
        F.sort_array(F.collect_set("aisle")).alias("aisles"),
    )
    joined = basics.join(common_terms(members), "family_id", "left").join(
        family_similarity(members, metric), "family_id"
    )
    first, second = F.get("terms", F.lit(0)), F.get("terms", F.lit(1))
    name = (
        F.when(second.isNotNull(), F.concat(title_case(first), F.lit(" "), title_case(second)))
        .when(first.isNotNull(), F.concat(title_case(first), F.lit(" Products")))
        .when(F.col("_lead_term").isNotNull(), title_case(F.col("_lead_term")))
        .otherwise(F.substring("representative_product", 1, 30))
    )
    return joined.select(
        "family_id",
        F.concat(name, F.lit(" Family")).alias("family_name"),
        "size",
        "representative_product",
        "departments",
        "aisles",
        "avg_similarity",
    )


def fuzzy_families(
    products: DataFrame,
    metric: Metric = JACCARD_WORDS,
    threshold: int = 80,
    min_size: int = 2,
    max_size: int = 15,
    window: int = WINDOW,
    block_rows: int = BLOCK_ROWS,
    fanout: int = FANOUT,
) -> Families:
    """Group enriched products (id, name, department, aisle) into fuzzy families."""
    placed = sort_products(products, metric)
    pairs = candidate_lists(placed, metric, threshold, window)
    assigned = assign_families(placed, pairs, min_size, max_size, window, block_rows, fanout)
    members = written(family_members(assigned, placed), "members")
    return Families(summarise_families(members, metric), members)


def largest_families(families: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` by size, then similarity."""
    return families.orderBy(F.desc("size"), F.desc("avg_similarity"), "family_id").limit(n)


def family_overview(families: DataFrame, n_products: int) -> DataFrame:
    """One row: families, grouped products and their share, sizes, mean similarity."""
    grouped = F.coalesce(F.sum("size"), F.lit(0))
    return families.agg(
        F.lit(n_products).cast("bigint").alias("total_products"),
        grouped.alias("grouped_products"),
        F.try_divide(grouped * 100.0, F.lit(float(n_products))).alias("grouped_percent"),
        F.count("*").alias("total_families"),
        F.avg("size").alias("avg_family_size"),
        F.max("size").alias("largest_family"),
        F.avg("avg_similarity").alias("avg_similarity"),
    )


def family_sizes(families: DataFrame) -> DataFrame:
    """(size, families)."""
    return families.groupBy("size").agg(F.count("*").alias("families"))


def department_families(families: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` departments found in most families, each family counted once."""
    return (
        families.select(F.explode("departments").alias("department"))
        .groupBy("department")
        .agg(F.count("*").alias("families"))
        .orderBy(F.desc("families"), "department")
        .limit(n)
    )


def search_families(found: Families, term: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` members whose name contains ``term``, with their relatives.

    One row per (match, other member); a match alone in its family has a NULL relative.
    """
    hits = (
        found.members.where(F.contains(F.lower("product_name"), F.lit(term.lower())))
        .orderBy("family_id", "member_no")
        .limit(limit)
        .select(
            "family_id",
            F.col("product_id").alias("match_id"),
            F.col("product_name").alias("match"),
        )
    )
    others = found.members.select(
        F.col("family_id").alias("_family"),
        F.col("product_id").alias("related_id"),
        F.col("product_name").alias("related"),
    )
    same_family = F.col("family_id") == F.col("_family")
    not_itself = F.col("related_id") != F.col("match_id")
    return (
        hits.join(others, same_family & not_itself, "left")
        .drop("_family")
        .join(
            found.families.select("family_id", "family_name", "size", "avg_similarity"),
            "family_id",
        )
    )
