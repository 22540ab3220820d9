"""Basket tables: one row per basket (headers) and one per distinct item in it (items).

Everything downstream works on these two long tables, so work is spread by
basket or by (user, item) and never by whole customers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.operators.position import with_key_positions
from trolley.operators.skew import attach_by_key
from trolley.storage import written


class Baskets(NamedTuple):
    """``headers``: user_id, basket_id, basket_pos, n_baskets, n_items, is_target.

    ``items``: basket_id, item_ord, item_id; ``item_ord`` sorts a basket's items.
    The last basket of a user is the target.
    """

    headers: DataFrame
    items: DataFrame

    def long(self) -> DataFrame:
        """(user_id, basket_id, basket_pos, n_baskets, is_target, item_ord, item_id)."""
        headers = self.headers.where("n_items > 0")
        return attach_by_key(self.items, headers, ["basket_id"], "n_items", cheap=True)


def distinct_basket_items(
    lineitem: DataFrame, line_order: str = "l_orderkey", item: str = "l_partkey"
) -> DataFrame:
    """(basket_id, item_id, item_ord): the distinct items of each order, by item id."""
    return (
        lineitem.select(F.col(line_order).alias("basket_id"), F.col(item).alias("item_id"))
        .where("basket_id IS NOT NULL AND item_id IS NOT NULL")
        .distinct()
        .withColumn("item_ord", F.col("item_id"))
    )


def baskets_from_orders(
    orders: DataFrame,
    lineitem: DataFrame,
    user: str = "o_custkey",
    order: str = "o_orderkey",
    date: str = "o_orderdate",
    line_order: str = "l_orderkey",
    item: str = "l_partkey",
) -> Baskets:
    """Baskets of order histories: distinct items per order, orders by (date, order id)."""
    items = written(distinct_basket_items(lineitem, line_order, item), "basket-items")
    sizes = items.groupBy("basket_id").agg(F.count("*").alias("n_items"))
    filled = orders.select(
        F.col(user).alias("user_id"), F.col(order).alias("basket_id"), F.col(date).alias("_at")
    ).join(sizes, "basket_id")
    headers = with_key_positions(
        filled, ["user_id"], ["_at", "basket_id"], "basket_pos", "n_baskets"
    ).drop("_at")
    headers = headers.withColumn("is_target", F.col("basket_pos") == F.col("n_baskets") - 1)
    return Baskets(written(headers, "basket-headers"), items)


def valid_sequences(df: DataFrame) -> DataFrame:
    """Rows whose sequence and target both parsed; ``user_id`` is ``row_idx`` where there is none.

    Ids of the file stay as they are: of any type, and any number of rows may share one.
    """
    rows = df.where("customer_sequence IS NOT NULL AND last_basket IS NOT NULL")
    if "row_idx" not in rows.columns:
        raise ValueError("number the rows first: row_idx is the default user id")
    return rows if "user_id" in rows.columns else rows.withColumn("user_id", F.col("row_idx"))


def baskets_from_sequences(df: DataFrame) -> Baskets:
    """Baskets of parsed sequence rows; the target follows the history baskets.

    Each row is a customer of its own: ``user_id`` of the headers is the row number, and
    ``file_user`` the id that the file gives the row.
    """
    rows = valid_sequences(df)
    every = rows.select(
        F.col("row_idx").alias("user_id"),
        F.col("user_id").alias("file_user"),
        F.posexplode(
            F.concat("customer_sequence", F.array("last_basket"))
        ).alias("basket_pos", "basket"),
        (F.size("customer_sequence") + 1).cast("bigint").alias("n_baskets"),
    ).select(
        "user_id",
        "file_user",
        F.concat_ws(":", "user_id", "basket_pos").alias("basket_id"),
        F.col("basket_pos").cast("bigint").alias("basket_pos"),
        "n_baskets",
        F.coalesce(F.size("basket"), F.lit(0)).cast("bigint").alias("n_items"),
        (F.col("basket_pos") == F.col("n_baskets") - 1).alias("is_target"),
        "basket",
    )
    headers = every.drop("basket")
    items = every.select("basket_id", F.posexplode("basket").alias("item_ord", "item_id"))
    return Baskets(headers, items.where("item_id IS NOT NULL"))


def nested_sequences(baskets: Baskets, max_baskets: int | None = None) -> DataFrame:
    """Back to one row per user: all baskets (or the last ``max_baskets``) and the target."""
    kept = baskets.headers
    if max_baskets is not None:
        kept = kept.where(F.col("basket_pos") >= F.col("n_baskets") - 1 - max_baskets)
    arrays = (
        Baskets(kept, baskets.items)
        .long()
        .groupBy("basket_id")
        .agg(F.sort_array(F.collect_list(F.struct("item_ord", "item_id"))).alias("_items"))
        .select("basket_id", F.col("_items.item_id").alias("_basket"))
    )
    empty = F.array().cast("array<bigint>")
    rows = kept.join(arrays, "basket_id", "left").withColumn(
        "_basket", F.coalesce("_basket", empty)
    )
    ordered = F.sort_array(
        F.collect_list(F.when(~F.col("is_target"), F.struct("basket_pos", "_basket")))
    )
    return rows.groupBy("user_id").agg(
        ordered.alias("_history"),
        F.first(F.when(F.col("is_target"), F.col("_basket")), ignorenulls=True).alias(
            "last_basket"
        ),
    ).select("user_id", F.col("_history._basket").alias("customer_sequence"), "last_basket")


def parsing_statistics(df: DataFrame) -> DataFrame:
    """Row counts of a parsed sequence table: total, valid and invalid rows."""
    ok = (F.size("customer_sequence") >= 2) & (F.size("last_basket") > 0)
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.coalesce(ok, F.lit(False))).alias("valid_sequences"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid_sequences"),
    )
