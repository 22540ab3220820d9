"""The training-data pipeline: from raw documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import mixing, near_duplicates, packing, quality, suffix_dedup
from trolley.llm.queries import tokenizer_path
from trolley.session import ship_package
from trolley.storage import written

# whole texts are wide rows: 10,000 of them would fill each Arrow batch with tens of
# megabytes, which the executor and its Python worker hold several times
BATCH_BYTES = "4m"

# a classifier, set likeness and token packing have no SQL form
ORACLE_SQL = None


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the batches of the session, also for whoever reads a stage's result."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking predicts to be good."""
    prepare(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are alike to 0.8 or more."""
    prepare(spark)
    return near_duplicates.keep_one(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur elsewhere; ``n_chars`` follows."""
    prepare(spark)
    cut = suffix_dedup.without_repeats(docs)
    length = F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])
    changed = F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path(), added_tokens=True)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("repeats", no_repeats),
    ("mixing", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
