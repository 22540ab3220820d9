"""Writers: every relation as Parquet (or JSON lines), with one metadata row beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.families import Families
from trolley.operators.linalg import SvdModel, factor_u, project, singular_report
from trolley.operators.tfidf import TermVectors
from trolley.operators.vocab import MASK_TOKEN, PAD_TOKEN, vocabulary_metadata


def _save(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).parquet(path)


def write_vocabulary(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``items``: item_id to token_id (both directions), ``metadata``: special tokens, size."""
    _save(vocab.select("item_id", "token_id"), f"{path}/items", mode)
    _save(vocabulary_metadata(vocab), f"{path}/metadata", mode)


def write_prepared(
    prepared: DataFrame,
    vocab: DataFrame,
    path: str,
    max_seq: int,
    max_basket: int,
    mode: str = "errorifexists",
) -> None:
    """Ragged rows in ``data``, partitioned by split, and ``metadata`` with widths and counts.

    Padding is left to ``read_prepared``, so the size of the files is that of the tokens.
    The counts come from the written files, so the pipeline runs once.
    """
    spark = prepared.sparkSession
    prepared.write.mode(mode).partitionBy("split").parquet(f"{path}/data")
    counts = spark.read.parquet(f"{path}/data").agg(
        F.count_if(F.col("split") == "train").alias("num_train"),
        F.count_if(F.col("split") == "val").alias("num_val"),
    ).first()
    n_terms = vocab.count()
    row = spark.range(1).select(
        F.lit(max_seq).alias("max_seq_length"),
        F.lit(max_basket).alias("max_basket_size"),
        F.lit(PAD_TOKEN).alias("pad_token"),
        F.lit(MASK_TOKEN).alias("mask_token"),
        F.lit(n_terms + 2).cast("bigint").alias("vocab_size"),
        F.lit(counts["num_train"]).cast("bigint").alias("num_train"),
        F.lit(counts["num_val"]).cast("bigint").alias("num_val"),
    )
    _save(row, f"{path}/metadata", mode)


def family_documents(found: Families) -> DataFrame:
    """One row per family with its products nested in member order."""
    product = F.struct(
        "member_no",
        "product_id",
        F.col("product_name").alias("name"),
        "department",
        "aisle",
    )
    nested = found.members.groupBy("family_id").agg(
        F.sort_array(F.collect_list(product)).alias("_p")
    )
    slim = F.transform(
        "_p",
        lambda p: F.struct(
            p["product_id"].alias("product_id"),
            p["name"].alias("name"),
            p["department"].alias("department"),
            p["aisle"].alias("aisle"),
        ),
    )
    return found.families.join(nested, "family_id").withColumn("products", slim).drop("_p")


def family_metadata(
    families: DataFrame, threshold: int, min_size: int, max_size: int, metric: str
) -> DataFrame:
    """One row: counts, mean size and similarity, and the parameters used."""
    return families.agg(
        F.count("*").alias("total_families"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_products_grouped"),
        F.lit(threshold).alias("similarity_threshold"),
        F.lit(min_size).alias("min_family_size"),
        F.lit(max_size).alias("max_family_size"),
        F.lit("fuzzy_matching_with_smart_sorting").alias("method"),
        F.avg("size").alias("avg_family_size"),
        F.avg("avg_similarity").alias("avg_similarity"),
        F.lit(metric).alias("metric"),
    )


def write_families(
    found: Families,
    path: str,
    threshold: int = 80,
    min_size: int = 2,
    max_size: int = 15,
    metric: str = "jaccard_words",
    mode: str = "errorifexists",
) -> None:
    """``families`` and ``metadata`` as JSON lines, split over files like any Spark output."""
    family_documents(found).write.mode(mode).json(f"{path}/families")
    family_metadata(found.families, threshold, min_size, max_size, metric).write.mode(mode).json(
        f"{path}/metadata"
    )


def write_similarity_vectors(
    text: TermVectors,
    vectors: DataFrame,
    n_products: int,
    path: str,
    n_flags: int = 12,
    mode: str = "errorifexists",
) -> None:
    """``vectors`` (id, idx, weight), ``vocabulary`` (term, idx) and ``metadata``."""
    spark = vectors.sparkSession
    _save(vectors, f"{path}/vectors", mode)
    _save(text.vocabulary.select("term", "idx"), f"{path}/vocabulary", mode)
    n_terms = text.vocabulary.count()
    row = spark.range(1).select(
        F.lit("product_similarity").alias("embedding_type"),
        F.lit("tfidf_plus_categorical").alias("method"),
        F.lit(n_products).cast("bigint").alias("products_count"),
        F.lit(n_terms).cast("bigint").alias("vocabulary_size"),
        F.lit(n_terms + n_flags).cast("bigint").alias("width"),
    )
    _save(row, f"{path}/metadata", mode)


def write_svd(
    model: SvdModel,
    vectors: DataFrame,
    composites: DataFrame,
    path: str,
    mode: str = "errorifexists",
) -> None:
    """``composites``, ``singular_values``, ``u``, ``v``, ``info`` and the fitted projection."""
    spark: SparkSession = vectors.sparkSession
    _save(composites, f"{path}/composites", mode)
    _save(singular_report(model, spark), f"{path}/singular_values", mode)
    _save(factor_u(model, spark), f"{path}/u", mode)
    v = project(vectors, model, scaled=True).select("item_id", F.col("reduced").alias("v"))
    _save(v, f"{path}/v", mode)
    width, r = model.u.shape
    info = spark.range(1).select(
        F.lit(r).alias("r_components"),
        F.lit(float(model.explained.sum())).alias("explained_variance"),
        F.lit(width).alias("u_rows"),
        F.lit(r).alias("u_columns"),
        F.lit(model.rows).cast("bigint").alias("v_rows"),
        F.array(*[F.lit(float(m)) for m in model.mean]).alias("mean"),
    )
    _save(info, f"{path}/info", mode)
    writer = model.pca.write()
    (writer.overwrite() if mode == "overwrite" else writer).save(f"{path}/projection")
