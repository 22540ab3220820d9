"""Library inputs derived from the given tables, and the same derivations as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.baskets import Baskets, baskets_from_orders, distinct_basket_items
from trolley.operators.catalogue import enrich_products


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> Baskets:
    return baskets_from_orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_basket_items(table(spark, sf_dir, "lineitem"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding", "label"
    )


# part names get a size, a food word by brand and a filler by size, so that every
# name rule has something to do; types and brands become departments and aisles
_BRAND = "cast(replace(p_brand, 'Brand#', '') AS int)"
_NAME = f"""concat_ws(' ',
    CASE WHEN p_size % 5 = 0 THEN 'Organic' WHEN p_size % 7 = 0 THEN 'Natural' END,
    p_name,
    CASE {_BRAND} % 6 WHEN 0 THEN 'Whole Milk' WHEN 1 THEN 'Chicken' WHEN 2 THEN 'Apple Juice'
        WHEN 3 THEN 'Bread' WHEN 4 THEN 'Ice Cream' END,
    concat(p_size, ' oz'))"""
_DEPARTMENT_ID = """CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'LARGE' THEN 3
    WHEN 'MEDIUM' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END"""
_DEPARTMENT = """CASE p_type WHEN 'ECONOMY' THEN 'produce' WHEN 'STANDARD' THEN 'dairy eggs'
    WHEN 'LARGE' THEN 'meat seafood' WHEN 'MEDIUM' THEN 'household'
    WHEN 'SMALL' THEN 'personal care' ELSE 'pantry' END"""
_AISLE = f"""CASE {_BRAND} % 5 WHEN 0 THEN 'fresh fruits' WHEN 1 THEN 'frozen meals'
    WHEN 2 THEN 'canned goods' WHEN 3 THEN 'packaged cheese' ELSE 'organic snacks' END"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        f"{_NAME} AS product_name",
        f"{_BRAND} AS aisle_id",
        f"{_DEPARTMENT_ID} AS department_id",
    )


def aisles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .selectExpr(f"{_BRAND} AS aisle_id", f"{_AISLE} AS aisle")
        .distinct()
    )


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .selectExpr(f"{_DEPARTMENT_ID} AS department_id", f"{_DEPARTMENT} AS department")
        .distinct()
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_products(
        products(spark, sf_dir), aisles(spark, sf_dir), departments(spark, sf_dir)
    )


BASKETS_SQL = """
items AS (SELECT DISTINCT l_orderkey AS basket_id, l_partkey AS item_id FROM lineitem),
sizes AS (SELECT basket_id, count(*) AS n_items FROM items GROUP BY basket_id),
placed_headers AS (
  SELECT o_custkey AS user_id, o_orderkey AS basket_id, n_items,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS basket_pos,
    count(*) OVER (PARTITION BY o_custkey) AS n_baskets
  FROM orders JOIN sizes ON basket_id = o_orderkey),
headers AS (SELECT *, basket_pos = n_baskets - 1 AS is_target FROM placed_headers),
vocab AS (
  SELECT item_id, row_number() OVER (ORDER BY item_id) + 1 AS token_id, frequency
  FROM (SELECT item_id, count(*) AS frequency FROM items GROUP BY item_id))
"""

PRODUCTS_SQL = f"""
products AS (
  SELECT p_partkey AS product_id, {_NAME} AS product_name,
    {_BRAND} AS aisle_id, {_DEPARTMENT_ID} AS department_id FROM part),
aisles AS (SELECT DISTINCT {_BRAND} AS aisle_id, {_AISLE} AS aisle FROM part),
departments AS (
  SELECT DISTINCT {_DEPARTMENT_ID} AS department_id, {_DEPARTMENT} AS department FROM part),
enriched AS (
  SELECT product_id, product_name, aisle_id, department_id,
    coalesce(aisle, 'Unknown') AS aisle, coalesce(department, 'Unknown') AS department
  FROM products LEFT JOIN aisles USING (aisle_id) LEFT JOIN departments USING (department_id))
"""

# the given embeddings have ids from 0 on, without special rows
VECTORS_SQL = """
vectors AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label FROM embeddings)
"""


def long_of(digest: str) -> str:
    """SQL for a keyed draw: the first 15 hex digits of a digest as a bigint."""
    return f"('0x' || substr({digest}, 1, 15))::BIGINT"
