"""Readers: CSV tables, nested list literals, embeddings and family files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.operators.encode import hide_baskets, pad_sequences
from trolley.operators.position import with_positions

# How the two sequence columns are recognised when not named exactly.
SEQUENCE_HINTS = {
    "customer_sequence": ("sequence", "history"),
    "last_basket": ("basket", "target"),
}
SPECIAL_VECTORS = 2  # leading padding and mask rows of an embedding matrix

PRODUCT_SCHEMA = (
    "product_id bigint, product_name string, aisle_id int, department_id int"
)
AISLE_SCHEMA = "aisle_id int, aisle string"
DEPARTMENT_SCHEMA = "department_id int, department string"
FAMILY_SCHEMA = (
    "family_id bigint, family_name string, size bigint, representative_product string, "
    "departments array<string>, aisles array<string>, avg_similarity double, "
    "products array<struct<product_id: bigint, name: string, department: string, aisle: string>>"
)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema every column is a string."""
    reader = spark.read.option("header", True)
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path)


def resolve_sequence_columns(df: DataFrame) -> DataFrame:
    """Rename the sequence and target columns to their canonical names.

    An exact name wins; otherwise the first column with a known hint in its name.
    """
    renames = {}
    for wanted, hints in SEQUENCE_HINTS.items():
        if wanted in df.columns:
            continue
        # a column serves one name only, and an exact one serves its own
        free = [c for c in df.columns if c not in renames and c not in SEQUENCE_HINTS]
        similar = [c for c in free if any(h in c.lower() for h in hints)]
        if not similar:
            close = [c for c in df.columns if wanted in c.lower()]
            raise ValueError(
                f"no column for {wanted!r} among {df.columns}; close matches: {close}"
            )
        renames[similar[0]] = wanted
    return df.withColumnsRenamed(renames)


def number_file_rows(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Number the rows of a file scan in file order."""
    tagged = df.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_line": F.monotonically_increasing_id(),
        }
    )
    return with_positions(tagged, ["_file", "_block", "_line"], name).drop(
        "_file", "_block", "_line"
    )


def _parsed(text: Column, sql_type: str, strict: bool) -> Column:
    text = F.trim(text)
    value = F.from_json(text, sql_type)
    if not strict:
        return value
    bad = text.isNotNull() & value.isNull()
    return F.when(
        bad, F.raise_error(F.concat(F.lit("not a list literal: "), text)).cast(sql_type)
    ).otherwise(value)


def parse_sequences(df: DataFrame, strict: bool = True) -> DataFrame:
    """Parse the sequence and target literals into nested arrays.

    ``strict`` fails on a malformed value; otherwise it becomes NULL and the row
    is dropped later by the validity filter.
    """
    return df.withColumns(
        {
            "customer_sequence": _parsed(
                F.col("customer_sequence"), "array<array<bigint>>", strict
            ),
            "last_basket": _parsed(F.col("last_basket"), "array<bigint>", strict),
        }
    )


def _digit_tokens(text: Column) -> Column:
    tokens = F.transform(F.split(text, ","), lambda t: F.trim(t))
    numbers = F.transform(
        F.filter(tokens, lambda t: t.rlike("^[0-9]+$")), lambda t: t.try_cast("bigint")
    )
    # a run of digits beyond a bigint is no item
    return F.filter(numbers, lambda n: n.isNotNull())


def parse_sequences_lenient(
    df: DataFrame, sequence_col: str = "sequence_idx", target_col: str = "last_basket_idx"
) -> DataFrame:
    """Parse list literals token by token, dropping all that is not a plain number.

    Baskets left empty disappear. Adds ``customer_sequence`` and ``last_basket``.
    """
    inner = F.regexp_replace(F.col(sequence_col), r"^[\[\]]+|[\[\]]+$", "")
    baskets = F.transform(
        F.split(inner, r"\], \["),
        lambda b: _digit_tokens(F.regexp_replace(b, r"^[\[\]]+|[\[\]]+$", "")),
    )
    target = F.regexp_replace(F.col(target_col), r"^[\[\]]+|[\[\]]+$", "")
    return df.withColumns(
        {
            "customer_sequence": F.filter(baskets, lambda b: F.size(b) > 0),
            "last_basket": _digit_tokens(target),
        }
    )


def item_vectors(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    skip: int = SPECIAL_VECTORS,
) -> DataFrame:
    """Item vectors as (item_id, embedding): special rows dropped, ids re-based to 0."""
    return embeddings.where(F.col(id_col) >= skip).select(
        (F.col(id_col) - skip).alias("item_id"), F.col(vector_col).alias("embedding")
    )


def vector_width(vectors: DataFrame, vector_col: str = "embedding") -> int:
    """The common width of the vectors; an error when they differ."""
    low, high = vectors.agg(
        F.min(F.size(vector_col)), F.max(F.size(vector_col))
    ).first()
    if low is None or low != high:
        raise ValueError(f"vectors must share one width, found {low}..{high}")
    return high


def read_families(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Family documents ``{metadata, families: {id: {...}}}``, one row per family.

    A document spread over several lines is read by one task; large ones go to
    ``read_large_families``.
    """
    family = T.StructType.fromDDL(FAMILY_SCHEMA)
    schema = T.StructType([T.StructField("families", T.MapType(T.StringType(), family))])
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return doc.select(F.explode("families").alias("key", "family")).select("family.*")


def read_large_families(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``read_families`` from documents of any size, on one line or many, in many tasks.

    The text is cut at ``"family_id":``. Inside a JSON string every quote has a backslash
    before it, so these bytes are always a key, and Spark's line reader finds them from
    any split. Families must have ``family_id`` as their first key, without space before
    the colon, as ``FAMILY_SCHEMA`` orders them; a document written otherwise is an error.
    """
    schema = T.StructType.fromDDL(FAMILY_SCHEMA)
    marker = '"family_id":'
    pieces = spark.read.option("lineSep", marker).text(path)
    # a piece closes its family and ends with the opening of the next one or of the file
    text = F.concat(F.lit("{" + marker), F.col("value"))
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    opened = F.col("value").rlike(r"\{\s*\z")
    closed = F.col("value").rlike(r"\}\s*\z")
    is_family = F.col("value").rlike(r"\A\s*-?[0-9]")
    spaced = F.col("value").rlike(r'"family_id"\s+:')
    whole = F.when(
        (F.trim("value") != "") & (~(opened | closed) | spaced),
        F.raise_error(F.lit("family_id must be the first key of a family, directly before its colon")).cast(schema),
    ).otherwise(value)
    return pieces.select(F.when(is_family | spaced | ~(opened | closed), whole).alias("family")).where(
        "family IS NOT NULL"
    ).select("family.*")


def family_members(families: DataFrame) -> DataFrame:
    """One row per (family_id, member_no, product)."""
    return families.select(
        "family_id", F.posexplode("products").alias("member_no", "product")
    ).select(
        "family_id",
        "member_no",
        "product.product_id",
        F.col("product.name").alias("product_name"),
        "product.department",
        "product.aisle",
    )


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """The prepared rows of ``write_prepared`` as they are stored, without padding."""
    return spark.read.parquet(f"{path}/data")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """The prepared rows at the widths of their metadata, with masked copies and labels.

    Padding is made row by row from the columns that are used, so a reader of, say, target
    tokens alone neither reads nor builds sequences.
    """
    sizes = spark.read.parquet(f"{path}/metadata").first()
    ragged = read_ragged(spark, path)
    padded = pad_sequences(ragged, sizes["max_basket_size"], sizes["max_seq_length"])
    return hide_baskets(padded) if "masked_positions" in ragged.columns else padded
