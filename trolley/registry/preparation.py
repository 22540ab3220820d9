"""Queries over basket preparation: vocabulary, statistics, encoding, masking, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators import baskets as bk
from trolley.operators import encode, split, stats, vocab
from trolley.plans.jobs import prepare_sequences
from trolley.registry.base import ORACLES, query, rounded
from trolley.registry.inputs import BASKETS_SQL, basket_items, baskets, table
from trolley.sources import tables as src
from trolley.storage import new_path

WITH = f"WITH {BASKETS_SQL}"


@query(
    "basket_long_form",
    f"""{WITH} SELECT user_id, basket_pos, n_baskets, is_target, item_id
    FROM headers JOIN items USING (basket_id)""",
)
def basket_long_form(spark: SparkSession, sf: str) -> DataFrame:
    return baskets(spark, sf).long().select(
        "user_id", "basket_pos", "n_baskets", "is_target", "item_id"
    )


@query("distinct_items", "SELECT DISTINCT l_partkey AS item_id FROM lineitem")
def distinct_items(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.distinct_items(basket_items(spark, sf))


@query("vocabulary", f"{WITH} SELECT item_id, token_id::INTEGER AS token_id, frequency FROM vocab")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.vocabulary(basket_items(spark, sf))


@query(
    "vocabulary_metadata",
    f"""{WITH} SELECT 0::INTEGER AS pad_token, 1::INTEGER AS mask_token,
    count(*) + 2 AS vocab_size FROM vocab""",
)
def vocabulary_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.vocabulary_metadata(vocab.vocabulary(basket_items(spark, sf)))


@query(
    "top_items",
    f"{WITH} SELECT item_id, frequency FROM vocab ORDER BY frequency DESC, item_id LIMIT 20",
)
def top_items(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.top_items(basket_items(spark, sf), 20)


@query("max_basket_size", f"{WITH} SELECT coalesce(max(n_items), 20) AS max_basket_size FROM headers")
def max_basket_size(spark: SparkSession, sf: str) -> DataFrame:
    sizes = basket_items(spark, sf).groupBy("basket_id").agg(F.count("*").alias("n_items"))
    held = table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket_id"))
    return sizes.join(held, "basket_id", "left_semi").agg(
        F.coalesce(F.max("n_items"), F.lit(vocab.DEFAULT_BASKET_SIZE)).alias("max_basket_size")
    )


@query(
    "basket_statistics",
    f"""{WITH}, measures AS (
      SELECT 'sequence_length' AS measure, n_baskets - 1 AS n FROM headers WHERE is_target
      UNION ALL SELECT 'basket_size', n_items FROM headers WHERE NOT is_target
      UNION ALL SELECT 'target_size', n_items FROM headers WHERE is_target),
    bounds AS (SELECT measure, min(n) AS lo, max(n) AS hi FROM measures GROUP BY measure),
    counted AS (
      SELECT measure, least(((n - lo) * 20) // (hi - lo), 19)::INTEGER AS bin, count(*) AS n
      FROM measures JOIN bounds USING (measure) GROUP BY 1, 2)
    SELECT b.measure, e.bin, round(lo + e.bin * (hi - lo) / 20.0::DOUBLE, 6) AS low,
      round(lo + (e.bin + 1) * (hi - lo) / 20.0::DOUBLE, 6) AS high, coalesce(c.n, 0) AS n
    FROM bounds b CROSS JOIN (SELECT range::INTEGER AS bin FROM range(20)) e
    LEFT JOIN counted c ON c.measure = b.measure AND c.bin = e.bin""",
)
def basket_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.basket_statistics(baskets(spark, sf)).withColumns(
        {"low": rounded("low"), "high": rounded("high")}
    )


_ENCODED_SQL = f"""{WITH},
width AS (SELECT max(n_items) AS w FROM headers),
known AS (
  SELECT basket_id, token_id, row_number() OVER (PARTITION BY basket_id ORDER BY item_id) AS rn
  FROM items JOIN vocab USING (item_id)),
tokens AS (SELECT basket_id, list(token_id ORDER BY rn) AS t FROM known GROUP BY basket_id),
padded AS (
  SELECT h.*, list_resize(t, w, 0) AS p, w FROM headers h JOIN tokens USING (basket_id), width),
history AS (
  SELECT user_id, list(p ORDER BY basket_pos) AS baskets FROM padded
  WHERE NOT is_target AND basket_pos >= n_baskets - 1 - 50 GROUP BY user_id),
encoded AS (
  SELECT t.user_id, t.w, t.p AS target, coalesce(h.baskets, []) AS baskets
  FROM padded t LEFT JOIN history h USING (user_id) WHERE t.is_target)
"""


def _joined(nested: str) -> Column:
    return F.array_join(F.transform(nested, lambda b: F.array_join(b, ",")), ";")


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    data = baskets(spark, sf)
    return encode.encode_sequences(data, vocab.vocabulary(data.items))


@query(
    "encoded_sequences",
    f"""{_ENCODED_SQL}, full_rows AS (
      SELECT user_id, target, len(baskets) AS n,
        list_resize(baskets, 50, list_resize([0], w, 0)) AS seq FROM encoded)
    SELECT user_id,
      array_to_string(list_transform(seq, lambda b: array_to_string(b, ',')), ';') AS sequence,
      array_to_string(list_resize(list_resize([]::INTEGER[], n, 1), 50, 0), ',') AS sequence_mask,
      array_to_string(list_transform(seq, lambda b: array_to_string(
        list_transform(b, lambda x: (x <> 0)::INTEGER), ',')), ';') AS basket_mask,
      array_to_string(target, ',') AS target_padded,
      array_to_string(list_sort(list_filter(target, lambda x: x <> 0)), ',') AS target_tokens
    FROM full_rows""",
)
def encoded_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select(
        "user_id",
        _joined("sequence").alias("sequence"),
        F.array_join("sequence_mask", ",").alias("sequence_mask"),
        _joined("basket_mask").alias("basket_mask"),
        F.array_join("target_padded", ",").alias("target_padded"),
        F.array_join("target_tokens", ",").alias("target_tokens"),
    )


@query(
    "target_token_sets",
    f"""{WITH} SELECT basket_id, token_id::INTEGER AS token_id
    FROM headers JOIN items USING (basket_id) JOIN vocab USING (item_id) WHERE is_target""",
)
def target_token_sets(spark: SparkSession, sf: str) -> DataFrame:
    data = baskets(spark, sf)
    sets = encode.target_token_sets(data, vocab.vocabulary(data.items))
    return sets.select("basket_id", F.explode("target_tokens").alias("token_id"))


@query(
    "masked_sequences",
    f"""{_ENCODED_SQL}, counted AS (
      SELECT user_id, w, baskets, len(baskets) AS n,
        greatest(1, floor(len(baskets) * 0.15::DOUBLE))::BIGINT AS m FROM encoded),
    draws AS (
      SELECT user_id, i, m, row_number() OVER (
        PARTITION BY user_id ORDER BY md5(concat_ws('|', '42', user_id, i)), i) AS rn
      FROM counted, range(50) r(i) WHERE i < n AND n > 1),
    chosen AS (SELECT user_id, list(i ORDER BY i) AS picked FROM draws WHERE rn <= m GROUP BY 1)
    SELECT c.user_id,
      coalesce(array_to_string(picked, ','), '') AS masked_positions,
      coalesce(array_to_string(list_transform(picked, lambda i:
        array_to_string(baskets[i + 1], ',')), ';'), '') AS masked_labels,
      array_to_string(list_transform(list_resize(baskets, 50, list_resize([0], w, 0)),
        lambda b, i: array_to_string(CASE WHEN list_contains(coalesce(picked, []), i - 1)
          THEN list_resize([1], w, 1) ELSE b END, ',')), ';') AS masked_sequence
    FROM counted c LEFT JOIN chosen USING (user_id)""",
)
def masked_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _masked(encode.mask_baskets(_encoded(spark, sf)))


def _masked(rows: DataFrame) -> DataFrame:
    return rows.select(
        "user_id",
        F.array_join("masked_positions", ",").alias("masked_positions"),
        _joined("masked_labels").alias("masked_labels"),
        _joined("masked_sequence").alias("masked_sequence"),
    )


_SPLIT_SQL = f"""{WITH}, ranked AS (
  SELECT user_id, count(*) OVER () AS n,
    row_number() OVER (ORDER BY md5(concat_ws('|', '42', user_id)), user_id) AS rn
  FROM headers WHERE is_target),
splits AS (
  SELECT user_id, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split
  FROM ranked)
"""


def _users(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with an order that holds anything; the order of orders does not matter here."""
    filled = table(spark, sf, "lineitem").where("l_partkey IS NOT NULL").select("l_orderkey")
    orders = table(spark, sf, "orders").join(filled, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return orders.select(F.col("o_custkey").alias("user_id")).distinct()


@query("train_val_split", f"{_SPLIT_SQL} SELECT user_id, split FROM splits")
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.assign_split(_users(spark, sf))


@query("split_counts", f"{_SPLIT_SQL} SELECT split, count(*) AS n FROM splits GROUP BY split")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_counts(split.assign_split(_users(spark, sf)))


@query(
    "prepared_output",
    f"""{_SPLIT_SQL} SELECT 50::INTEGER AS max_seq_length,
      (SELECT max(n_items) FROM headers)::INTEGER AS max_basket_size,
      0::INTEGER AS pad_token, 1::INTEGER AS mask_token,
      (SELECT count(*) + 2 FROM vocab) AS vocab_size,
      count(*) FILTER (split = 'train') AS num_train,
      count(*) FILTER (split = 'val') AS num_val FROM splits""",
)
def prepared_output(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "prepared")
    prepare_sequences(baskets(spark, sf), path=path)
    return spark.read.parquet(f"{path}/metadata")


@query(
    "prepared_rows",
    f"""{_SPLIT_SQL}, lengths AS (
      SELECT user_id, split, least(n_baskets - 1, 50) AS n, n_items AS target_items
      FROM splits JOIN headers USING (user_id) WHERE is_target)
    SELECT user_id, split, n::INTEGER AS n_history, target_items::INTEGER AS n_target,
      CASE WHEN n > 1 THEN greatest(1, floor(n * 0.15::DOUBLE)) ELSE 0 END::INTEGER AS n_masked
    FROM lengths""",
)
def prepared_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "prepared")
    prepare_sequences(baskets(spark, sf), path=path)
    return src.read_prepared(spark, path).select(
        "user_id",
        F.col("split"),
        F.aggregate("sequence_mask", F.lit(0), lambda a, m: a + m).alias("n_history"),
        F.size("target_tokens").alias("n_target"),
        F.size("masked_positions").alias("n_masked"),
    )


@query("stored_sequences", ORACLES["masked_sequences"])
def stored_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Masked sequences through the ragged files and the padding reader."""
    path = new_path(spark, "prepared")
    prepare_sequences(baskets(spark, sf), path=path)
    return _masked(src.read_prepared(spark, path))


def _sequence_file(spark: SparkSession, sf: str, sequence: str, target: str) -> str:
    """The histories as a CSV of list literals, the form customer files come in."""
    nested = bk.nested_sequences(baskets(spark, sf))
    path = new_path(spark, "sequences")
    literal = "concat('[', array_join(transform({0}, b -> concat('[', array_join(b, ', '), ']')), ', '), ']')"
    nested.selectExpr(
        "user_id",
        f"{literal.format('customer_sequence')} AS `{sequence}`",
        f"concat('[', array_join(last_basket, ', '), ']') AS `{target}`",
    ).write.option("header", True).csv(path)
    return path


_WHOLE_SQL = """whole AS (
  SELECT user_id, basket_pos, is_target, item_id FROM headers JOIN items USING (basket_id))"""


def _file_rows(parsed: bk.Baskets) -> DataFrame:
    return parsed.long().select(
        F.col("file_user").cast("bigint").alias("user_id"), "basket_pos", "is_target", "item_id"
    )


@query(
    "csv_sequences_strict",
    f"""{WITH}, {_WHOLE_SQL} SELECT user_id, basket_pos, is_target, item_id FROM whole""",
)
def csv_sequences_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Columns under other names, found by hint; strict literals; back to long form."""
    path = _sequence_file(spark, sf, "Order_History", "target_items")
    raw = src.number_file_rows(src.resolve_sequence_columns(src.read_csv(spark, path)))
    parsed = bk.baskets_from_sequences(src.parse_sequences(raw))
    return _file_rows(parsed)


@query(
    "csv_sequences_lenient",
    f"""{WITH}, {_WHOLE_SQL} SELECT user_id, basket_pos, is_target, item_id FROM whole""",
)
def csv_sequences_lenient(spark: SparkSession, sf: str) -> DataFrame:
    path = _sequence_file(spark, sf, "sequence_idx", "last_basket_idx")
    raw = src.number_file_rows(src.read_csv(spark, path))
    parsed = bk.baskets_from_sequences(src.parse_sequences_lenient(raw))
    return _file_rows(parsed)


@query(
    "csv_sequences_shared_ids",
    f"""{WITH}, {_WHOLE_SQL}, named AS (
      SELECT 'u' || (user_id // 3) AS file_user, user_id, max(basket_pos) + 1 AS n_baskets,
        count(*) AS n_items FROM whole GROUP BY user_id)
    SELECT file_user, n_baskets, n_items, count(*) AS n_rows FROM named
    GROUP BY file_user, n_baskets, n_items""",
)
def csv_sequences_shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Text ids that several rows share: every row stays a customer of its own."""
    path = _sequence_file(spark, sf, "customer_sequence", "last_basket")
    raw = src.number_file_rows(src.read_csv(spark, path)).withColumn(
        "user_id", F.expr("concat('u', cast(user_id AS bigint) div 3)")
    )
    long = bk.baskets_from_sequences(src.parse_sequences(raw)).long()
    per_row = long.groupBy("user_id", "file_user").agg(
        (F.max("basket_pos") + 1).alias("n_baskets"), F.count("*").alias("n_items")
    )
    return per_row.groupBy("file_user", "n_baskets", "n_items").agg(F.count("*").alias("n_rows"))


@query(
    "parsing_statistics",
    f"""{WITH} SELECT count(*) AS total_rows,
      count(*) FILTER (n_baskets >= 3) AS valid_sequences,
      count(*) FILTER (n_baskets < 3) AS invalid_sequences FROM headers WHERE is_target""",
)
def parsing_statistics(spark: SparkSession, sf: str) -> DataFrame:
    path = _sequence_file(spark, sf, "sequence_idx", "last_basket_idx")
    return bk.parsing_statistics(src.parse_sequences_lenient(src.read_csv(spark, path)))


@query(
    "default_user_ids",
    f"""{WITH} SELECT row_number() OVER (ORDER BY user_id) - 1 AS row_idx
    FROM headers WHERE is_target""",
)
def default_user_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a file without user ids get their row number as the id."""
    path = _sequence_file(spark, sf, "customer_sequence", "last_basket")
    raw = src.number_file_rows(src.read_csv(spark, path).drop("user_id"))
    rows = bk.valid_sequences(src.parse_sequences(raw, strict=False))
    return rows.select(F.col("user_id").alias("row_idx"))


@query("csv_products", "SELECT p_partkey AS product_id, p_name AS product_name FROM part")
def csv_products(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue written as CSV and read with its explicit schema."""
    path = new_path(spark, "products")
    table(spark, sf, "part").selectExpr(
        "p_partkey AS product_id", "p_name AS product_name", "1 AS aisle_id", "2 AS department_id"
    ).write.option("header", True).csv(path)
    return src.read_csv(spark, path, src.PRODUCT_SCHEMA).select("product_id", "product_name")
