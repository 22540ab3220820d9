"""Leave-out candidate ranking: cases, negatives, rankers and hit metrics.

A case is one (user, positive item). Its candidates travel as one array of
1 + n items with the positive first, so ranking a case never needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.functions.hashing import hash_to_long, keyed_hash, numbered_longs
from trolley.functions.vectors import mean_vector
from trolley.operators.baskets import Baskets
from trolley.operators.position import with_key_positions, with_positions
from trolley.operators.skew import attach_by_key
from trolley.storage import outliving, passing, spread, written

HISTORY_FRACTION = 0.8
NEGATIVES = 99
TOP_K = 10
# a history up to this long travels with its cases; longer ones are joined in long form
INLINE_HISTORY = 5_000
DRAWS_AT_ONCE = 1_000
# hashes in one array operation, and cases drawn or scored at a time in a task
HASHES_AT_ONCE = 16_384
CASES_AT_ONCE = 1_000
SCORED_AT_ONCE = 100
PAIRS_AT_ONCE = 10_000
# item ids up to this many are shared with every task; with more, places join their ids
LISTED_ITEMS = 4_000_000
# an item matrix up to this size is shared with every task; beyond it blocks of
# ``CELL_BYTES`` meet blocks of cases
SHARED_MATRIX_BYTES = 256 * 1024 * 1024
CELL_BYTES = 64 * 1024 * 1024
# with a hundred candidates each, about as many bytes of them in a cell as of vectors
CASES_PER_BLOCK = 60_000
# cases whose candidates lie on the disk at a time, where only their ranks are kept
CASES_PER_PART = 1_000_000

SCORED = "user_id bigint, positive_item bigint, candidates array<bigint>, scores array<double>"
CASE_COLUMNS = ["user_id", "positive_item", "positive_pos", "history_size"]

Ranker = Callable[[DataFrame], DataFrame]


class Evaluation(NamedTuple):
    """``cases``: user_id, positive_item, history_size. ``history``: user_id, item_id, times.

    ``times`` counts the history baskets with the item; ``usage`` is the table both
    come from.
    """

    cases: DataFrame
    history: DataFrame
    usage: DataFrame


def item_usage(
    baskets: Baskets,
    known_items: DataFrame | None = None,
    history_fraction: float = HISTORY_FRACTION,
    max_users: int | None = None,
) -> DataFrame:
    """(user_id, item_id, in_history, in_test, times) for users fit for evaluation.

    Fit: two or more non-empty history baskets and a non-empty target. The leading
    max(1, floor(n * fraction)) baskets are history, the others and the target test.
    Items outside ``known_items`` (item_id) are left out.
    """
    filled = baskets.headers.where("n_items > 0")
    # the position among the non-empty baskets equals basket_pos unless some are empty
    gaps = baskets.headers.where("n_items = 0").limit(1).count() > 0
    if gaps:
        filled = _renumber(filled)
    n_history = F.col("n_baskets") - 1
    fit = filled.where(n_history >= 2)
    if max_users is not None:
        everyone = baskets.headers.where("is_target").select("user_id")
        users = everyone.orderBy("user_id").limit(max_users)
        fit = fit.join(users, "user_id", "left_semi")
    split = F.greatest(F.lit(1), F.floor(n_history * F.lit(history_fraction)))
    lines = Baskets(
        fit.withColumn("is_history", F.col("basket_pos") < split), baskets.items
    ).long()
    if known_items is not None:
        lines = lines.join(known_items.select("item_id"), "item_id", "left_semi")
    return lines.groupBy("user_id", "item_id").agg(
        F.bool_or("is_history").alias("in_history"),
        F.bool_or(~F.col("is_history")).alias("in_test"),
        F.count_if("is_history").alias("times"),
    )


def _renumber(headers: DataFrame) -> DataFrame:
    """Positions and counts over the non-empty baskets; users without target drop out."""
    kept = headers.drop("n_baskets").withColumnRenamed("basket_pos", "_old")
    dense = with_key_positions(kept, ["user_id"], ["_old"], "basket_pos", "n_baskets")
    targets = dense.where("is_target").select("user_id")
    return dense.drop("_old").join(targets, "user_id", "left_semi")


def evaluation_cases(
    baskets: Baskets,
    known_items: DataFrame | None = None,
    history_fraction: float = HISTORY_FRACTION,
    max_users: int | None = None,
) -> Evaluation:
    """Cases: test items of users with a history, not in that history."""
    usage = written(
        item_usage(baskets, known_items, history_fraction, max_users), "item-usage"
    )
    history = usage.where("in_history").select("user_id", "item_id", "times")
    sizes = usage.groupBy("user_id").agg(
        F.count_if("in_history").alias("history_size"), F.count("*").alias("_rows")
    )
    fresh = usage.where("in_test AND NOT in_history").select(
        "user_id", F.col("item_id").alias("positive_item")
    )
    cases = (
        attach_by_key(fresh, sizes, ["user_id"], "_rows").drop("_rows").where("history_size > 0")
    )
    return Evaluation(written(cases, "cases"), history, usage)


def case_statistics(evaluation: Evaluation) -> DataFrame:
    """One row: cases and the mean, shortest and longest history over the cases."""
    return evaluation.cases.agg(
        F.count("*").alias("test_cases"),
        F.avg("history_size").alias("avg_history"),
        F.min("history_size").alias("min_history"),
        F.max("history_size").alias("max_history"),
    )


def leakage_count(evaluation: Evaluation) -> DataFrame:
    """One row: test items dropped because the user's history already has them."""
    return evaluation.usage.agg(
        F.count_if(F.col("in_history") & F.col("in_test")).alias("data_leakage_detected")
    )


class DrawStream(NamedTuple):
    """The random stream of catalogue positions each case draws from.

    The stream is fixed by the case; ``factor`` only sets how much of it is read.
    """

    n_items: int
    wanted: int
    factor: float
    seed: int

    def length(self) -> Column:
        """Draws to read: the expected need n * ln(free / (free - wanted)) and a margin."""
        free = F.lit(float(self.n_items)) - F.col("history_size") - 1
        need = self.n_items * F.log((free + 0.5) / (free - self.wanted + 0.5))
        # the draws that are no use number about ``need - wanted``, with that variance
        waste = F.greatest(need - self.wanted, F.lit(0.0))
        return F.ceil(need * self.factor + 4 * F.sqrt(waste) + 3)

    def at(self, k: Column) -> Column:
        """The ``k``-th draw."""
        digest = keyed_hash(self.seed, "user_id", "positive_item", k)
        return hash_to_long(digest) % self.n_items


def _draws_of_batch(batch: pa.RecordBatch, stream: DrawStream) -> np.ndarray:
    """The first ``wanted`` places of each case's stream that its history leaves free."""
    keys, blocked = batch.column("key").cast(pa.binary()), batch.column("blocked")
    data, bounds = np.frombuffer(keys.buffers()[2] or b"", np.uint8), _offsets(keys)
    sizes, cuts = np.diff(bounds), _offsets(blocked)
    taken, lengths = blocked.flatten().to_numpy(), batch.column("draws").to_numpy()
    own = batch.column("positive_pos").fill_null(-1).to_numpy()
    n, wanted = stream.n_items, stream.wanted
    found = np.zeros((batch.num_rows, wanted), np.int64)
    # cases with keys of one length and about as many draws are hashed together
    order = np.lexsort((lengths, sizes))
    at = 0
    while at < len(order):
        tile = order[at : at + HASHES_AT_ONCE // 64]
        tile = tile[sizes[tile] == sizes[tile[0]]]
        tile = tile[: max(1, int(np.sum(lengths[tile] * np.arange(1, len(tile) + 1) <= HASHES_AT_ONCE)))]
        at += len(tile)
        many = max(wanted, int(min(lengths[tile[-1]], HASHES_AT_ONCE)))
        prefixes = data[bounds[tile][:, None] + np.arange(sizes[tile[0]])]
        rows = numbered_longs(prefixes, 0, many) % n
        found[tile] = rows[:, :wanted]
        # most cases take their first draws as they are
        first = np.sort(rows[:, :wanted], axis=1)
        dull = (first[:, 1:] == first[:, :-1]).any(axis=1)
        n_taken = np.diff(cuts)[tile]
        which = np.repeat(np.arange(len(tile)), n_taken)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n_taken) - n_taken, n_taken)
        barred = np.concatenate([taken[cuts[tile][which] + within], own[tile]])
        which = np.concatenate([which, np.arange(len(tile))])
        flat = (first + n * np.arange(len(tile))[:, None]).ravel()
        wall = barred + n * which
        spot = np.minimum(np.searchsorted(flat, wall), len(flat) - 1)
        dull[which[(flat[spot] == wall) & (barred >= 0)]] = True
        for i in np.flatnonzero(dull).tolist():
            case, read = int(tile[i]), many
            bars = {int(own[case]), *taken[cuts[case] : cuts[case + 1]].tolist()}
            free = [x for x in dict.fromkeys(rows[i].tolist()) if x not in bars]
            while len(free) < wanted:
                more = numbered_longs(prefixes[i : i + 1], read, HASHES_AT_ONCE)[0] % n
                free = list(dict.fromkeys(free + [x for x in more.tolist() if x not in bars]))
                read += HASHES_AT_ONCE
            found[case] = free[:wanted]
    return found


def _offsets(values: pa.Array) -> np.ndarray:
    """Where the elements of each row of a list or binary column begin, and the end."""
    if isinstance(values, pa.ListArray):
        return values.offsets.to_numpy() - values.offsets[0].as_py()
    return np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]


def _inline_negatives(
    cases: DataFrame, blocked: DataFrame, stream: DrawStream, low: int = 0, facts: tuple[str, ...] = ()
) -> DataFrame:
    """The first draws outside the history, which meets the case where it is drawn.

    Short histories leave most of the catalogue free, so the draws are few; each case
    reads its stream until it has enough, so it must have enough free items. Cases and
    histories move apart from each other, a history once per user. ``low`` is added to
    the places; ``facts`` are further columns of ``blocked`` to keep.
    """
    ready = attach_by_key(
        cases, blocked, ["user_id"], "n_cases", "left", cheap=True, spread_by=["user_id", "positive_item"]
    )
    key = F.concat_ws("|", F.lit(str(stream.seed)), *[F.col(c).cast("string") for c in ("user_id", "positive_item")])
    kept = [*CASE_COLUMNS, *facts]
    rows = ready.select(
        *kept, stream.length().cast("bigint").alias("draws"), F.concat(key, F.lit("|")).alias("key"),
        F.coalesce("blocked", F.array().cast("array<bigint>")).alias("blocked"),
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, CASES_AT_ONCE):
                batch = whole.slice(first, CASES_AT_ONCE)
                places = _draws_of_batch(batch, stream) + low
                bounds = pa.array(np.arange(len(places) + 1, dtype=np.int32) * stream.wanted)
                lists = pa.ListArray.from_arrays(bounds, pa.array(places.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "negatives"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes) + ", negatives array<bigint>"
    return rows.mapInArrow(draw, schema)


def _joined_negatives(cases: DataFrame, history: DataFrame, stream: DrawStream) -> DataFrame:
    """The same for histories of any length: draws as rows, anti-joined on (user, position).

    A nearly complete history may need very many draws, so they are generated in
    stretches and never stand in one array.
    """
    last = F.floor(stream.length() / DRAWS_AT_ONCE)
    stretches = spread(cases, "user_id", "positive_item").select(
        *CASE_COLUMNS, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("stretch")
    )
    start = F.col("stretch") * DRAWS_AT_ONCE
    drawn = stretches.select(
        *CASE_COLUMNS, F.explode(F.sequence(start, start + (DRAWS_AT_ONCE - 1))).alias("k")
    )
    free = (
        drawn.withColumn("pos", stream.at(F.col("k")))
        .where(~F.col("pos").eqNullSafe(F.col("positive_pos")))
        .join(history, ["user_id", "pos"], "left_anti")
        .groupBy("user_id", "positive_item", "pos")
        .agg(F.min("k").alias("k"))
    )
    # the length of the stream is such that about ``wanted`` free items come up
    listed = free.groupBy("user_id", "positive_item").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("k", "pos"))), 1, stream.wanted)
        .getField("pos")
        .alias("negatives")
    )
    return (
        cases.select(*CASE_COLUMNS)
        .join(listed, ["user_id", "positive_item"], "left")
        .withColumn("negatives", F.coalesce("negatives", F.array().cast("array<bigint>")))
        .select(*CASE_COLUMNS, "negatives")
    )


def catalogue_places(catalogue: DataFrame) -> DataFrame:
    """(item_id, pos): the distinct items of ``catalogue`` (item_id) numbered in id order."""
    return with_positions(catalogue.select("item_id").distinct(), ["item_id"])


def sample_candidates(
    evaluation: Evaluation,
    catalogue: DataFrame,
    n: int = NEGATIVES,
    seed: int = 42,
    inline_history: int = INLINE_HISTORY,
    facts: DataFrame | None = None,
    keep: bool = True,
    places: DataFrame | None = None,
) -> DataFrame:
    """(user_id, positive_item, candidates): the positive and ``n`` keyed random negatives.

    Negatives are uniform without replacement over ``catalogue`` (item_id) minus the
    history and the positive: the first ``n`` admissible values of the case's own
    random stream. Cases with fewer than ``n`` admissible items are left out; see
    ``skipped_cases``. History items and positives outside the catalogue block nothing;
    such a positive is ranked all the same. Long histories whose cases are still short
    after a read of the stream get a longer one.

    ``facts`` (one row per user_id) come out beside the candidates. The result is written
    unless ``keep`` is off, which is for a single reader: candidates are then drawn as
    they are read and never lie on disk. ``places`` are ``catalogue_places`` made before, for
    callers that sample more than once.
    """
    places = catalogue_places(catalogue) if places is None else places
    n_items, low, high = places.agg(F.count("*"), F.min("item_id"), F.max("item_id")).first()
    if n_items == 0:
        raise ValueError("the catalogue is empty")
    # ids without gaps: position and id differ by a constant
    known = places.where("item_id IS NOT NULL").count() == n_items
    dense = known and isinstance(low, int) and high - low + 1 == n_items
    history = written(
        evaluation.history.join(places, "item_id").select("user_id", "pos"), "history-places"
    )
    placed = written(
        _placed_cases(evaluation, places, history)
        .where(F.col("blocked_items") + n <= n_items)
        .select(*CASE_COLUMNS),
        "case-places",
    )
    per_user = placed.groupBy("user_id").agg(
        F.count("*").alias("n_cases"), F.max("history_size").alias("_size")
    )
    short_users = per_user.where(F.col("_size") <= inline_history).drop("_size")
    blocked = short_users.join(
        history.groupBy("user_id").agg(F.collect_list("pos").alias("blocked")), "user_id", "left"
    )
    names = () if facts is None else tuple(c for c in facts.columns if c != "user_id")
    if facts is not None:
        blocked = blocked.join(facts, "user_id", "left")
    is_short = F.col("history_size") <= inline_history
    short = _inline_negatives(
        placed.where(is_short), written(blocked, "blocked"), DrawStream(n_items, n, 1.0, seed), low if dense else 0, names
    )
    out = short if dense else _with_items(short, places)
    todo, factor = placed.where(~is_short), 1.3
    while not todo.isEmpty():
        found = written(_joined_negatives(todo, history, DrawStream(n_items, n, factor, seed)), "negatives")
        done = _with_items(found.where(F.size("negatives") == n), places, low if dense else None)
        if facts is not None:
            sizes = per_user.where(F.col("_size") > inline_history).drop("_size")
            done = attach_by_key(done, sizes.join(facts, "user_id", "left"), ["user_id"], "n_cases")
        out = out.select(*CASE_COLUMNS, *names, "negatives").unionByName(done.select(*CASE_COLUMNS, *names, "negatives"))
        todo = found.where(F.size("negatives") < n).drop("negatives")
        factor *= 4
    out = out.select(
        "user_id", "positive_item", F.concat(F.array("positive_item"), "negatives").alias("candidates"), *names
    )
    return written(out, "candidates") if keep else out


def parsing_report(baskets: Baskets, evaluation: Evaluation) -> DataFrame:
    """One row: customers, those fit and unfit for evaluation, leaked test items and cases.

    Fit customers have two history baskets at least and a target.
    """
    fit = F.col("n_baskets") >= 3
    return baskets.headers.where("is_target").agg(
        F.count("*").alias("total_rows"),
        F.count_if(fit).alias("valid_sequences"),
        F.count_if(~fit).alias("invalid_sequences"),
        F.lit(leakage_count(evaluation).first()[0]).cast("bigint").alias("data_leakage_detected"),
        F.lit(evaluation.cases.count()).cast("bigint").alias("test_cases"),
    )


def _placed_cases(evaluation: Evaluation, places: DataFrame, history: DataFrame) -> DataFrame:
    """Cases with the positive's place (null outside the catalogue) and what they block.

    ``history_size`` becomes the number of history items inside the catalogue.
    """
    inside = history.groupBy("user_id").agg(F.count("*").alias("_inside"))
    per_user = evaluation.cases.groupBy("user_id").agg(F.count("*").alias("_rows"))
    sizes = per_user.join(inside, "user_id", "left")
    positives = places.select(
        F.col("item_id").alias("positive_item"), F.col("pos").alias("positive_pos")
    )
    size = F.coalesce("_inside", F.lit(0)).cast("bigint")
    return (
        attach_by_key(evaluation.cases.drop("history_size"), sizes, ["user_id"], "_rows")
        .join(positives, "positive_item", "left")
        .withColumn("history_size", size)
        .withColumn("blocked_items", size + F.col("positive_pos").isNotNull().cast("int"))
        .drop("_inside", "_rows")
    )


def _with_items(found: DataFrame, places: DataFrame, low: int | None = None) -> DataFrame:
    """Turn catalogue positions back into item ids; ``low`` is the first id of one without gaps."""
    if low is not None:
        return found.withColumn("negatives", F.transform("negatives", lambda p: p + F.lit(low)))
    rows = places.count()
    if rows <= LISTED_ITEMS:
        # one id a place: looked up where the positions are
        ids = places.orderBy("pos").select("item_id").toArrow()["item_id"].combine_chunks()
        listed = places.sparkSession.sparkContext.broadcast(ids)

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("negatives")
                lists = batch.column(at)
                items = pa.ListArray.from_arrays(pa.array(_offsets(lists).astype(np.int32)), listed.value.take(lists.flatten()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:at], items, *batch.columns[at + 1 :]], names=batch.schema.names
                )

        item = dict(places.dtypes)["item_id"]
        types = {**dict(found.dtypes), "negatives": f"array<{item}>"}
        return found.mapInArrow(name, ", ".join(f"`{c}` {types[c]}" for c in found.columns))
    single = found.select("user_id", "positive_item", F.posexplode("negatives").alias("k", "pos"))
    back = (
        single.join(places, "pos")
        .groupBy("user_id", "positive_item")
        .agg(F.sort_array(F.collect_list(F.struct("k", "item_id"))).alias("_i"))
        .select(F.col("user_id").alias("_user"), F.col("positive_item").alias("_positive"), F.col("_i.item_id").alias("_items"))
    )
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("positive_item").eqNullSafe(F.col("_positive"))
    return found.join(back, same).withColumn("negatives", F.col("_items")).drop("_user", "_positive", "_items")


def skipped_cases(
    evaluation: Evaluation, catalogue: DataFrame, n: int = NEGATIVES
) -> DataFrame:
    """One row: cases without enough admissible negatives in ``catalogue`` (item_id)."""
    items = catalogue.select("item_id").distinct()
    n_items = items.count()
    places = items.withColumn("pos", F.col("item_id"))
    history = evaluation.history.join(items, "item_id").select("user_id")
    short = F.col("blocked_items") + n > n_items
    return _placed_cases(evaluation, places, history).agg(F.count_if(short).alias("skipped"))


def rank_random(seed: int = 42) -> Ranker:
    """Scores from a keyed hash of (user, positive, item)."""

    def rank(candidates: DataFrame) -> DataFrame:
        # 13 hex digits are exact in a double
        score = F.transform(
            "candidates",
            lambda item: -hash_to_long(
                keyed_hash(seed, F.lit("rank"), "user_id", "positive_item", item), 13
            ).cast("double"),
        )
        return candidates.withColumn("scores", score)

    return rank


def _times_by_join(candidates: DataFrame, purchases: DataFrame) -> DataFrame:
    """(user_id, positive_item, _seen): candidates found in histories, for histories of any length."""
    single = candidates.select(
        "user_id", "positive_item", F.explode("candidates").alias("item_id")
    )
    seen = single.join(purchases, ["user_id", "item_id"])
    # only candidates found in a history travel on
    return seen.groupBy("user_id", "positive_item").agg(
        F.map_from_entries(F.collect_list(F.struct("item_id", "times"))).alias("_seen")
    )


def rank_frequency(purchases: DataFrame, inline_history: int = INLINE_HISTORY) -> Ranker:
    """Scores are the number of history baskets of (user_id, item_id) in ``times``.

    Histories without leakage never contain a candidate, so such cases fall back to
    item order. A history of up to ``inline_history`` items meets its user's cases as one
    map; candidates of users with longer ones are joined in long form.
    """

    def rank(candidates: DataFrame) -> DataFrame:
        rows = purchases.select("user_id", "item_id", "times")
        cases = candidates.groupBy("user_id").agg(F.count("*").alias("_cases"))
        sizes = written(
            rows.groupBy("user_id").agg(F.count("*").alias("_size")).join(cases, "user_id"), "history-sizes"
        )
        is_long = F.col("_size") > inline_history
        long_users = sizes.where(is_long).select("user_id")
        maps = rows.join(sizes.where(~is_long), "user_id").groupBy("user_id", "_cases").agg(
            F.map_from_entries(F.collect_list(F.struct("item_id", "times"))).alias("_seen")
        )
        seen = F.transform(
            "candidates", lambda item: F.coalesce(F.try_element_at("_seen", item).cast("double"), F.lit(0.0))
        )
        keyed = ["user_id", "positive_item"]
        if long_users.isEmpty():
            ready = attach_by_key(candidates, maps, ["user_id"], "_cases", "left", spread_by=keyed)
        else:
            short = attach_by_key(
                candidates.join(long_users, "user_id", "left_anti"), maps, ["user_id"], "_cases", "left", spread_by=keyed
            ).drop("_cases")
            long = candidates.join(long_users, "user_id", "left_semi")
            long_rows = rows.join(long_users, "user_id", "left_semi")
            ready = short.unionByName(long.join(_times_by_join(long, long_rows), keyed, "left"))
        return ready.select(*candidates.columns, seen.alias("scores"))

    return rank


def user_profiles(
    history: DataFrame,
    vectors: DataFrame,
    col: str = "embedding",
    limit_bytes: int = SHARED_MATRIX_BYTES,
) -> DataFrame:
    """(user_id, profile): the mean vector of a user's distinct history items.

    A user's distinct items are at most the catalogue, so no group is unbounded.
    """
    rows = history.select("user_id", "item_id")
    items = vectors.select("item_id", F.col(col).alias("_v"))
    if matrix_bytes(vectors, col) <= limit_bytes:
        # ids move to their user's partition first; vectors are then looked up there
        rows, items = spread(rows, "user_id"), F.broadcast(items)
    return (
        rows.join(items, "item_id")
        .groupBy("user_id")
        .agg(mean_vector(F.col("_v")).alias("profile"))
    )


def matrix_bytes(vectors: DataFrame, col: str) -> int:
    """Size of the vectors as a dense matrix of doubles."""
    rows, width = vectors.agg(F.count("*"), F.max(F.size(col))).first()
    return rows * (width or 0) * 8


def shared_matrix(vectors: DataFrame, col: str, limit_bytes: int):
    """(ids, vectors) as a broadcast in id order, or None when it is too large.

    The size is checked before anything is gathered. Every task holds a copy, so vectors of
    floats stay floats; rows are turned to doubles and unit length where they are used.
    """
    size = matrix_bytes(vectors, col)
    if size == 0 or size > limit_bytes:
        return None
    element = dict(vectors.dtypes)[col]
    element = element if element == "array<float>" else "array<double>"
    local = vectors.select("item_id", F.col(col).cast(element).alias("v")).toArrow()
    ids = local["item_id"].to_numpy()
    values = local["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    order = np.argsort(ids)
    return vectors.sparkSession.sparkContext.broadcast((ids[order], values[order]))


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows at unit length, zero rows unchanged."""
    length = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(length == 0, 1.0, length)


def packed_profiles(profiles: DataFrame) -> DataFrame:
    """(user_id, profile): each profile as the bytes of its numbers, cheap to carry beside each case."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("profile")
            cuts = (_offsets(lists) * 8).astype(np.int32)
            flat = np.ascontiguousarray(lists.flatten().to_numpy())
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), packed], names=["user_id", "profile"])

    rows = profiles.where("profile IS NOT NULL").select("user_id", F.col("profile").cast("array<double>").alias("profile"))
    return rows.mapInArrow(pack, f"user_id {dict(rows.dtypes)['user_id']}, profile binary")


def _profile_matrix(profiles: pa.Array, width: int) -> np.ndarray:
    """Unit profiles; a missing one is the zero vector."""
    known = np.asarray(profiles.is_valid())
    out = np.zeros((len(profiles), width))
    if pa.types.is_binary(profiles.type):
        cuts = _offsets(profiles)
        flat = np.frombuffer((profiles.buffers()[2] or pa.py_buffer(b""))[int(cuts[0]) : int(cuts[-1])], np.float64)
    else:
        flat = profiles.drop_null().flatten().to_numpy()
    out[known] = flat.reshape(-1, width)
    return unit_rows(out)


def _score_in_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for whole in batches:
            # a candidate's vector is gathered for a few cases at a time
            for first in range(0, whole.num_rows, SCORED_AT_ONCE):
                batch = whole.slice(first, SCORED_AT_ONCE)
                lists = batch.column("candidates")
                offsets, wanted = _offsets(lists), lists.flatten().to_numpy()
                items = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                profiles = _profile_matrix(batch.column("profile"), vectors.shape[1])
                known = np.flatnonzero(ids[items] == wanted)
                values = np.zeros(len(wanted))
                unit = unit_rows(vectors[items[known]].astype(float))
                values[known] = np.einsum("ij,ij->i", unit, profiles[owner[known]])
                scores = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("user_id"), batch.column("positive_item"), lists, scores],
                    names=["user_id", "positive_item", "candidates", "scores"],
                )

    return score


def rank_embedding(
    history: DataFrame,
    vectors: DataFrame,
    col: str = "embedding",
    limit_bytes: int = SHARED_MATRIX_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> Ranker:
    """Scores are cosines between the user's mean history vector and the candidates.

    A candidate without a vector, and every candidate of a user without a profile,
    scores 0, as the zero vector does. A profile is made once per user, not per case;
    candidates may bring it along (``packed_profiles`` as facts of ``sample_candidates``). An
    item matrix within the size limit is shared and scored in Arrow batches; blocks of a
    larger one meet blocks of cases.
    """

    def rank(candidates: DataFrame) -> DataFrame:
        shared = shared_matrix(vectors, col, limit_bytes)
        if "profile" in candidates.columns and shared is not None:
            return candidates.mapInArrow(_score_in_batches(shared), SCORED)
        profiles = user_profiles(history, vectors, col, limit_bytes)
        sizes = candidates.groupBy("user_id").agg(F.count("*").alias("_rows"))
        if shared is None:
            return _score_in_cells(candidates, sizes, profiles, vectors, col, cell_bytes)
        ready = attach_by_key(
            candidates, sizes.join(profiles, "user_id", "left"), ["user_id"], "_rows"
        ).drop("_rows")
        return ready.mapInArrow(_score_in_batches(shared), SCORED)

    return rank


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """A block for each id by a hash, so that ids of any pattern spread evenly."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(blocks)).astype(np.int32)


class _Vectors(NamedTuple):
    """Ids in order, the row of ``values`` each has, and the vectors."""

    ids: np.ndarray
    rows: np.ndarray
    values: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each wanted id, and whether it is there; some vector must be."""
        at = np.minimum(np.searchsorted(self.ids, wanted), len(self.ids) - 1)
        return self.rows[at], self.ids[at] == wanted


def _vectors_by_id(table: pa.Table, is_item: bool) -> _Vectors:
    """The vectors of the items or of the people of a cell."""
    chosen = table.filter(pa.compute.equal(table["is_item"], is_item))
    ids = chosen["id"].to_numpy()
    values = chosen["v" if is_item else "profile"].combine_chunks().flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return _Vectors(ids[order], order, values.reshape(len(ids), -1) if len(ids) else values[None])


def _met_scores(
    items: _Vectors, people: _Vectors, users: np.ndarray, case: np.ndarray, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted items (``case`` says whose) have a vector and a profile here, and their cosines."""
    if not (len(items.ids) and len(people.ids) and len(wanted)):
        return np.zeros(0, np.int64), np.zeros(0)
    person, has_profile = people.find(users)
    item, has_vector = items.find(wanted)
    met = np.flatnonzero(has_vector & has_profile[case])
    scores = np.empty(len(met))
    for first in range(0, len(met), PAIRS_AT_ONCE):
        some = met[first : first + PAIRS_AT_ONCE]
        left = unit_rows(items.values[item[some]].astype(float))
        right = unit_rows(people.values[person[case[some]]].astype(float))
        scores[first : first + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", left, right)
    return met, scores


def _lists_of_cell(lists: pa.Table, column: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """A few cases at a time: their rows, where their lists begin, and case and item of each element."""
    for first in range(0, lists.num_rows, CASES_AT_ONCE):
        part = lists.slice(first, CASES_AT_ONCE)
        column_part = part[column].combine_chunks()
        cuts = _offsets(column_part)
        yield part, cuts, np.repeat(np.arange(part.num_rows), np.diff(cuts)), column_part.flatten().to_numpy()


def _cell_scored(lists: pa.Table, known: pa.Table) -> pa.Table:
    """All candidates of the cases of a cell with their scores, where one block has all items."""
    items, people = (_vectors_by_id(known, kind) for kind in (True, False))
    names = ["user_id", "positive_item", "candidates", "scores"]
    done = [lists.schema.empty_table().select(names[:3]).append_column("scores", pa.array([], pa.list_(pa.float64())))]
    for part, cuts, case, wanted in _lists_of_cell(lists, "candidates"):
        met, scores = _met_scores(items, people, part["user_id"].to_numpy(), case, wanted)
        values = np.zeros(len(wanted))
        values[met] = scores
        listed = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))
        done.append(part.select(names[:3]).append_column("scores", listed))
    return pa.concat_tables(done)


def _cell_scores(lists: pa.Table, known: pa.Table) -> pa.Table:
    """Scores of the candidates whose item vector and profile are in the cell."""
    items, people = (_vectors_by_id(known, kind) for kind in (True, False))
    names = ["user_id", "positive_item", "ks", "scores"]
    done = [lists.schema.empty_table().select(names[:3]).append_column("scores", pa.array([], pa.list_(pa.float64())))]
    for part, _, case, wanted in _lists_of_cell(lists, "items"):
        met, scores = _met_scores(items, people, part["user_id"].to_numpy(), case, wanted)
        case, places = case[met], part["ks"].combine_chunks().flatten().to_numpy()[met]
        # a row for each case that has scores here
        starts = np.flatnonzero(np.diff(case, prepend=-1))
        cuts = pa.array(np.append(starts, len(case)).astype(np.int32))
        own = part.select(names[:2]).take(pa.array(case[starts]))
        own = own.append_column("ks", pa.ListArray.from_arrays(cuts, pa.array(places, pa.int32())))
        done.append(own.append_column("scores", pa.ListArray.from_arrays(cuts, pa.array(scores))))
    return pa.concat_tables([part.cast(done[0].schema) for part in done])


def _split_lists(item_blocks: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per case and block of items with its candidates there, of items known to have vectors."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, CASES_AT_ONCE):
                batch = whole.slice(first, CASES_AT_ONCE)
                lists = batch.column("candidates")
                sizes, items = np.diff(_offsets(lists)), lists.flatten().to_numpy()
                case = np.repeat(np.arange(batch.num_rows), sizes)
                k = (np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                if shared is not None and len(items):
                    ids = shared.value
                    met = np.flatnonzero(ids[np.minimum(np.searchsorted(ids, items), len(ids) - 1)] == items)
                    case, k, items = case[met], k[met], items[met]
                block = _block_of(items, item_blocks)
                order = np.lexsort((block, case))
                case, k, items, block = case[order], k[order], items[order], block[order]
                new = (np.diff(case, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)
                starts = np.flatnonzero(new)
                cuts = pa.array(np.append(starts, len(case)).astype(np.int32))
                own = batch.select(["case_block", "user_id", "positive_item"]).take(pa.array(case[starts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[starts]), *own.columns, pa.ListArray.from_arrays(cuts, pa.array(k)),
                     pa.ListArray.from_arrays(cuts, pa.array(items))],
                    names=["item_block", "case_block", "user_id", "positive_item", "ks", "items"],
                )

    return split


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores found in the cells in the order of the candidates, 0 where there is none."""
    for batch in batches:
        lists = batch.column("candidates")
        cuts = _offsets(lists)
        values = np.zeros(int(cuts[-1]))
        ks, scores = (batch.column(c) for c in ("ks", "scores"))
        owner = np.repeat(cuts[:-1], np.diff(_offsets(ks)))
        values[owner + ks.flatten().to_numpy()] = scores.flatten().to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column("user_id"), batch.column("positive_item"), lists,
             pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))],
            names=["user_id", "positive_item", "candidates", "scores"],
        )


def _score_in_cells(
    candidates: DataFrame, sizes: DataFrame, profiles: DataFrame, vectors: DataFrame, col: str, cell_bytes: int
) -> DataFrame:
    """Cosines for matrices of any size: blocks of items meet blocks of cases.

    Where one block has all items, a case sends it its candidates and they come back scored.
    Otherwise it sends each block of items one row with its candidates there, and gets one
    row of scores back. Item vectors go once to each block of cases and profiles once to
    each block of items; both kinds of block are as large as a task can hold, so these
    copies stay few. The cases of a user with many of them are dealt to several blocks, and
    the profile to each of these.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col(col).isNotNull())
    rows, width = vectors.agg(F.count("*"), F.max(F.size(col))).first()
    element = dict(vectors.dtypes)[col]
    element = element if element in ("array<float>", "array<double>") else "array<double>"
    per_block = max(1, cell_bytes // (8 * (width or 1)))
    # floats travel as they are, half as many bytes
    item_blocks = max(1, -(-rows // (per_block * (2 if element == "array<float>" else 1))))
    sizes = written(sizes, "case-counts")
    n_cases, n_users = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count("*")).first()
    case_blocks = max(
        -(-n_users // per_block), -(-n_cases // (CASES_PER_BLOCK * item_blocks)),
        min(n_cases, spark.sparkContext.defaultParallelism), 1,
    )
    dealt = F.greatest(F.ceil(F.col("_rows") * case_blocks / F.lit(max(n_cases, 1))), F.lit(1)).cast("int")
    sizes = sizes.select("user_id", "_rows", dealt.alias("_dealt"))
    shared = None
    if item_blocks > 1 and rows <= LISTED_ITEMS:
        shared = spark.sparkContext.broadcast(np.sort(vectors.select("item_id").toArrow()["item_id"].to_numpy()))

    def case_block(part: Column) -> Column:
        return F.pmod(F.xxhash64("user_id", part.cast("int")), F.lit(case_blocks)).cast("int")

    own = case_block(F.pmod(F.xxhash64("positive_item"), F.coalesce("_dealt", F.lit(1))))
    many = sizes.where("_dealt > 1")
    # few users have more than a block of cases
    lists = candidates.select("user_id", "positive_item", "candidates").join(
        F.broadcast(many.select("user_id", "_dealt")), "user_id", "left"
    ).select("user_id", "positive_item", "candidates", own.alias("case_block"))
    if item_blocks == 1:
        lists = lists.withColumn("item_block", F.lit(0))
    else:
        lists = lists.mapInArrow(
            _split_lists(item_blocks, shared),
            "item_block int, case_block int, user_id bigint, positive_item bigint, ks array<int>, items array<bigint>",
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = pa.array(_block_of(batch.column("id").to_numpy(), item_blocks))
            yield pa.RecordBatch.from_arrays([block, *batch.columns], names=["item_block", *batch.schema.names])

    items = vectors.select(F.col("item_id").cast("bigint").alias("id"), F.col(col).cast(element).alias("v"))
    items = items.mapInArrow(blocks, f"item_block int, id bigint, v {element}").select(
        "item_block", F.explode(F.sequence(F.lit(0), F.lit(case_blocks - 1))).alias("case_block"),
        F.lit(True).alias("is_item"), "id", "v", F.lit(None).cast("array<double>").alias("profile"),
    )
    parts = F.explode(F.sequence(F.lit(0), F.col("_dealt") - 1))
    people = profiles.where("profile IS NOT NULL").join(sizes, "user_id").select("user_id", "profile", parts.alias("part"))
    people = people.select("user_id", case_block(F.col("part")).alias("case_block"), "profile").dropDuplicates(["user_id", "case_block"])
    people = people.select(
        F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("item_block"), "case_block", F.lit(False).alias("is_item"),
        F.col("user_id").cast("bigint").alias("id"), F.lit(None).cast(element).alias("v"), F.col("profile").cast("array<double>").alias("profile"),
    )
    cell = ["item_block", "case_block"]
    cells = lists.groupBy(*cell).cogroup(items.unionByName(people).groupBy(*cell))
    if item_blocks == 1:
        return cells.applyInArrow(_cell_scored, SCORED)
    scored = cells.applyInArrow(_cell_scores, "user_id bigint, positive_item bigint, ks array<int>, scores array<double>")
    scored = scored.groupBy("user_id", "positive_item").agg(
        F.flatten(F.collect_list(F.struct("ks", "scores"))["ks"]).alias("ks"),
        F.flatten(F.collect_list(F.struct("ks", "scores"))["scores"]).alias("scores"),
    )
    scored = scored.select(F.col("user_id").alias("_user"), F.col("positive_item").alias("_positive"), "ks", "scores")
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("positive_item").eqNullSafe(F.col("_positive"))
    whole = candidates.join(scored, same, "left").select(
        "user_id", "positive_item", "candidates", F.coalesce("ks", F.array().cast("array<int>")).alias("ks"),
        F.coalesce("scores", F.array().cast("array<double>")).alias("scores"),
    )
    return whole.mapInArrow(_filled, SCORED)


def positive_ranks(scored: DataFrame) -> DataFrame:
    """(user_id, positive_item, rank): 1-based, equal scores ordered by item id."""
    own = F.get("scores", F.lit(0))
    better = F.filter(
        F.arrays_zip("candidates", "scores"),
        lambda c: (c["scores"] > own)
        | ((c["scores"] == own) & (c["candidates"] < F.col("positive_item"))),
    )
    return scored.select("user_id", "positive_item", (F.size(better) + 1).alias("rank"))


def evaluation_parts(evaluation: Evaluation, most: int = CASES_PER_PART) -> list[Evaluation]:
    """The evaluation cut by user into parts of about ``most`` cases.

    The cases of a user with many of them are dealt to all parts, each with that history.
    """
    parts = max(1, -(-evaluation.cases.count() // most))
    if parts == 1:
        return [evaluation]
    per_user = evaluation.cases.groupBy("user_id").count()
    # such users number at most four a part
    hot = [row["user_id"] for row in per_user.where(F.col("count") > most // 4).select("user_id").collect()]
    is_hot = F.coalesce(F.col("user_id").isin(hot), F.lit(False))
    dealt = F.when(is_hot, F.xxhash64("user_id", "positive_item")).otherwise(F.xxhash64("user_id"))

    def part(key: Column, i: int) -> Column:
        return F.pmod(key, F.lit(parts)) == i

    return [
        Evaluation(
            evaluation.cases.where(part(dealt, i)),
            evaluation.history.where(part(F.xxhash64("user_id"), i) | is_hot),
            evaluation.usage.where(part(F.xxhash64("user_id"), i) | is_hot),
        )
        for i in range(parts)
    ]


def ranks_in_parts(
    evaluation: Evaluation,
    catalogue: DataFrame,
    ranker_of: Callable[[Evaluation], Ranker],
    most: int = CASES_PER_PART,
) -> DataFrame:
    """``positive_ranks`` of sampled candidates, written for a part of the cases after the other.

    ``ranker_of`` gives the ranker of a part from its history. What a part has on the disk is
    deleted before the next begins, shuffle files too, so that candidates and scores of
    about ``most`` cases lie there however many there are.
    """
    spark = evaluation.cases.sparkSession
    ranks = None
    with passing(spark):
        places = catalogue_places(catalogue)
        for part in evaluation_parts(evaluation, most):
            with passing(spark):
                candidates = sample_candidates(part, catalogue, places=places)
                rows = positive_ranks(ranker_of(part)(candidates))
                with outliving(2):
                    found = written(rows, "ranks")
            ranks = found if ranks is None else ranks.unionByName(found)
    return ranks


def method_metrics(ranks: DataFrame, method: str, k: int = TOP_K) -> DataFrame:
    """One row: hits at 1, 5 and ``k``, hit rate, mean and median rank of the positive."""

    def hits(limit: int) -> Column:
        return F.count_if(F.col("rank") <= limit)

    def rate(limit: int) -> Column:
        return F.coalesce(F.try_divide(hits(limit), F.count("*")), F.lit(0.0))

    return ranks.agg(
        F.lit(method).alias("method"),
        rate(k).alias("hit_rate"),
        hits(k).alias("total_hits"),
        F.count("*").alias("total_tests"),
        F.coalesce(F.avg("rank"), F.lit(0.0)).alias("avg_rank"),
        # ranks are at most the number of candidates, so the exact median is cheap
        F.coalesce(F.median("rank"), F.lit(0.0)).alias("median_rank"),
        rate(1).alias("hit1"),
        rate(5).alias("hit5"),
    )


def evaluate(
    candidates: DataFrame,
    rankers: dict[str, Ranker],
    k: int = TOP_K,
    skipped: DataFrame | None = None,
) -> DataFrame:
    """One metrics row per ranker, all on the same candidates.

    ``skipped`` (one row, from ``skipped_cases``) becomes a column of each.
    """
    out = None
    for method, ranker in rankers.items():
        row = method_metrics(positive_ranks(ranker(candidates)), method, k)
        out = row if out is None else out.unionByName(row)
    return out if skipped is None else out.withColumn(
        "skipped", F.lit(skipped.first()[0]).cast("bigint")
    )


# The percent bounds of the sanity verdicts.
RANDOM_EXPECTED, RANDOM_TOLERANCE = 10.0, 3.0
FREQUENCY_HIGH, FREQUENCY_LOW = 50.0, 5.0
EMBEDDING_GOOD, EMBEDDING_MODERATE = 50.0, 30.0


def compare(results: DataFrame, full: str = "embedding", reduced: str = "reduced") -> DataFrame:
    """Add place, sanity verdict, best embedding method and retention of the reduced one.

    ``results`` has one row per method, so the unpartitioned window stays tiny.
    """
    percent = F.col("hit_rate") * 100
    is_random = F.col("method").contains("random")
    is_frequency = F.col("method").contains("frequency")
    is_embedding = F.col("method").isin(full, reduced)
    verdict = (
        F.when(
            is_random,
            F.when(F.abs(percent - RANDOM_EXPECTED) > RANDOM_TOLERANCE, "unusual").otherwise(
                "correct"
            ),
        )
        .when(
            is_frequency,
            F.when(percent > FREQUENCY_HIGH, "too high")
            .when(percent < FREQUENCY_LOW, "correct")
            .otherwise("reasonable"),
        )
        .when(
            is_embedding,
            F.when(percent >= EMBEDDING_GOOD, "good")
            .when(percent >= EMBEDDING_MODERATE, "moderate")
            .otherwise("low"),
        )
    )
    every = W.partitionBy(F.lit(0))
    best = F.max_by(
        F.when(is_embedding, F.col("method")),
        F.when(is_embedding, F.struct("hit_rate", "method")),
    ).over(every)
    full_rate = F.max(F.when(F.col("method") == full, F.col("hit_rate"))).over(every)
    reduced_rate = F.max(F.when(F.col("method") == reduced, F.col("hit_rate"))).over(every)
    top_rate = F.max(F.when(is_embedding, percent)).over(every)
    return results.withColumns(
        {
            "hit_rate_percent": percent,
            "place": F.row_number().over(every.orderBy(F.desc("hit_rate"), "method")),
            "verdict": verdict,
            "best_embedding": best,
            "retention_percent": F.when(
                (full_rate > 0) & (reduced_rate > 0), reduced_rate / full_rate * 100
            ),
            "overall": F.when(top_rate >= EMBEDDING_GOOD, "excellent")
            .when(top_rate >= EMBEDDING_MODERATE, "good")
            .otherwise("needs improvement"),
        }
    )
