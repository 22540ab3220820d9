"""Padded, masked token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.functions.hashing import keyed_hash
from trolley.operators.baskets import Baskets
from trolley.operators.vocab import MASK_TOKEN, PAD_TOKEN, attach_tokens, max_basket_size


def pad_right(values: Column, width: int, filler: Column) -> Column:
    """The first ``width`` values, filled up on the right."""
    kept = F.slice(values, 1, width)
    return F.concat(kept, F.array_repeat(filler, F.lit(width) - F.size(kept)))


def item_mask(tokens: Column) -> Column:
    """1 for an item token, 0 for padding."""
    return F.transform(tokens, lambda t: (t != PAD_TOKEN).cast("int"))


def token_baskets(baskets: Baskets, vocab: DataFrame, max_basket: int | None = None) -> DataFrame:
    """(basket_id, tokens): the first ``max_basket`` known tokens of each basket, or all.

    The rank filter is applied in part before the shuffle, so an outsized basket
    sends only its leading items.
    """
    known = attach_tokens(baskets.items, vocab)
    if max_basket is not None:
        rank = F.row_number().over(W.partitionBy("basket_id").orderBy("item_ord"))
        known = known.withColumn("_rank", rank).where(F.col("_rank") <= max_basket)
    return (
        known.groupBy("basket_id")
        .agg(F.sort_array(F.collect_list(F.struct("item_ord", "token_id"))).alias("_t"))
        .select("basket_id", F.col("_t.token_id").alias("tokens"))
    )


def ragged_sequences(
    baskets: Baskets, vocab: DataFrame, max_seq: int = 50, max_basket: int | None = None
) -> DataFrame:
    """(user_id, baskets, target, target_tokens): token baskets as long as they are.

    Only the last ``max_seq`` history baskets are kept, picked by position before
    anything is gathered, so a row never holds more than max_seq + 1 baskets, and a huge
    basket widens its own user's row only. ``target_tokens`` are the sorted distinct
    tokens of the whole target, also where ``max_basket`` cuts ``target``.
    """
    recent = Baskets(
        baskets.headers.where(F.col("basket_pos") >= F.col("n_baskets") - 1 - max_seq),
        baskets.items,
    )
    none = F.array().cast("array<int>")
    rows = recent.headers.join(token_baskets(recent, vocab, max_basket), "basket_id", "left")
    rows = rows.withColumn("tokens", F.coalesce("tokens", none))
    history = F.sort_array(
        F.collect_list(F.when(~F.col("is_target"), F.struct("basket_pos", "tokens")))
    )

    def of_target(col: str) -> Column:
        return F.first(F.when(F.col("is_target"), F.col(col)), ignorenulls=True)

    grouped = rows.groupBy("user_id").agg(
        history.getField("tokens").alias("baskets"),
        F.coalesce(of_target("tokens"), none).alias("target"),
        of_target("basket_id").alias("_target_id"),
    )
    if max_basket is None:
        # nothing was cut off
        return grouped.withColumn("target_tokens", F.sort_array(F.array_distinct("target"))).drop("_target_id")
    targets = target_token_sets(baskets, vocab).withColumnRenamed("basket_id", "_target_id")
    return (
        grouped.join(targets, "_target_id", "left")
        .withColumn("target_tokens", F.coalesce("target_tokens", none))
        .drop("_target_id")
    )


def pad_sequences(ragged: DataFrame, width: int, max_seq: int) -> DataFrame:
    """Ragged rows at full width: sequence, its masks and the target; other columns stay.

    Row by row and without a shuffle, so it can wait until the rows are read.
    """
    filler = F.lit(PAD_TOKEN)
    basket = F.array_repeat(filler, width)
    full = F.transform("baskets", lambda b: pad_right(b, width, filler))
    kept = [c for c in ragged.columns if c not in ("user_id", "baskets", "target", "target_tokens")]
    return ragged.select(
        "user_id",
        pad_right(full, max_seq, basket).alias("sequence"),
        pad_right(F.transform("baskets", lambda _: F.lit(1)), max_seq, F.lit(0)).alias("sequence_mask"),
        pad_right(F.col("target"), width, filler).alias("target_padded"),
        "target_tokens",
        *kept,
    ).withColumn("basket_mask", F.transform("sequence", item_mask))


def encode_sequences(
    baskets: Baskets,
    vocab: DataFrame,
    max_seq: int = 50,
    max_basket: int | None = None,
) -> DataFrame:
    """One row per user: padded sequence, masks, padded target and its token set.

    The rows of ``ragged_sequences`` at the width of the largest basket or ``max_basket``.
    The target set is sparse: sorted distinct tokens in place of a multi-hot row.
    """
    largest = max_basket_size(baskets)
    width = max_basket or largest
    ragged = ragged_sequences(baskets, vocab, max_seq, width if width < largest else None)
    return pad_sequences(ragged, width, max_seq)


def target_token_sets(baskets: Baskets, vocab: DataFrame) -> DataFrame:
    """(basket_id, target_tokens): the distinct tokens of each whole target basket."""
    target_ids = baskets.headers.where("is_target").select("basket_id")
    items = baskets.items.join(target_ids, "basket_id", "left_semi")
    return (
        attach_tokens(items, vocab)
        .groupBy("basket_id")
        .agg(F.sort_array(F.collect_set("token_id")).alias("target_tokens"))
    )


def masked_positions(n: Column, prob: float, seed: int) -> Column:
    """The sorted positions to hide among ``n`` baskets: max(1, floor(n * prob)) by keyed hash.

    Sequences with one basket or none hide nothing.
    """
    wanted = F.greatest(F.lit(1), F.floor(n * F.lit(prob)).cast("int"))
    order = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(keyed_hash(seed, "user_id", i).alias("h"), i.alias("i")),
        )
    )
    picked = F.sort_array(F.slice(order, 1, wanted).getField("i"))
    return F.when(n > 1, picked).otherwise(F.array().cast("array<int>"))


def mask_ragged(ragged: DataFrame, prob: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``masked_positions``; what they hide follows when the rows are padded."""
    return ragged.withColumn("masked_positions", masked_positions(F.size("baskets"), prob, seed))


def hide_baskets(encoded: DataFrame) -> DataFrame:
    """The baskets at ``masked_positions`` become all-mask, the padded originals the labels."""
    return encoded.withColumn(
        "masked_sequence",
        F.transform(
            "sequence",
            lambda basket, i: F.when(
                F.array_contains("masked_positions", i),
                F.transform(basket, lambda _: F.lit(MASK_TOKEN)),
            ).otherwise(basket),
        ),
    ).withColumn(
        "masked_labels",
        F.transform("masked_positions", lambda i: F.get(F.col("sequence"), i)),
    )


def mask_baskets(encoded: DataFrame, prob: float = 0.15, seed: int = 42) -> DataFrame:
    """Hide a share of each padded sequence's baskets; narrow, no shuffle."""
    n = F.aggregate("sequence_mask", F.lit(0), lambda acc, m: acc + m)
    return hide_baskets(encoded.withColumn("masked_positions", masked_positions(n, prob, seed)))
