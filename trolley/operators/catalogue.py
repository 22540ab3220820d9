"""Product rows enriched with their dimensions and derived text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.functions.text import extract_key_terms, product_text, smart_sort_key


def enrich_products(
    products: DataFrame, aisles: DataFrame | None = None, departments: DataFrame | None = None
) -> DataFrame:
    """Left-join the aisle and department names; 'Unknown' where there is none.

    The dimensions are a few hundred rows and the join strategy is the planner's,
    so an unexpectedly large dimension is shuffled and not broadcast.
    """
    out = products
    if aisles is not None:
        out = out.join(aisles, "aisle_id", "left")
    elif "aisle" not in out.columns:
        out = out.withColumn("aisle", F.lit(None).cast("string"))
    if departments is not None:
        out = out.join(departments, "department_id", "left")
    elif "department" not in out.columns:
        out = out.withColumn("department", F.lit(None).cast("string"))
    return out.withColumns(
        {
            "aisle": F.coalesce("aisle", F.lit("Unknown")),
            "department": F.coalesce("department", F.lit("Unknown")),
        }
    )


def with_key_terms(products: DataFrame) -> DataFrame:
    """Add ``key_terms`` and ``sort_key``; a missing name counts as empty."""
    name = F.coalesce("product_name", F.lit(""))
    return (
        products.withColumn("product_name", name)
        .withColumn("key_terms", extract_key_terms(F.col("product_name")))
        .withColumn("sort_key", smart_sort_key(F.col("product_name"), F.col("key_terms")))
    )


def with_product_text(products: DataFrame) -> DataFrame:
    """Add ``text``: the weighted product text used for term vectors.

    'Unknown' stands for a missing dimension and is left out of the text.
    """

    def known(col: str) -> Column:
        return F.nullif(F.col(col), F.lit("Unknown"))

    return products.withColumn(
        "text", product_text(F.col("product_name"), known("department"), known("aisle"))
    )
