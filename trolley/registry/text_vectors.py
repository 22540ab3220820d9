"""Queries over TF-IDF and combined product similarity vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators import catalogue_neighbours as cn
from trolley.operators import neighbours as nb
from trolley.operators import tfidf as tf
from trolley.operators.catalogue import with_product_text
from trolley.plans.jobs import build_similarity_vectors
from trolley.registry.base import query, rounded
from trolley.registry.catalogue import TEXT_SQL
from trolley.registry.inputs import PRODUCTS_SQL, aisles, departments, enriched, products, table
from trolley.storage import new_path, written

_STOP = ", ".join(f"'{w}'" for w in tf.STOP_WORDS)


def _tfidf_sql(docs: str) -> str:
    """CTEs from ``docs`` (id, text) to ``vocabulary`` and unit-length ``weights``."""
    return rf"""docs AS ({docs}),
words AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'),
  lambda w: regexp_full_match(w, '[a-zA-Z][a-zA-Z0-9]*') AND w NOT IN ({_STOP})) AS w FROM docs),
terms AS (SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)),
  lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
counts AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term),
n AS (SELECT count(*) AS n FROM docs),
admissible AS (
  SELECT term, count(*) AS df, sum(tf) AS total_tf FROM counts GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.8::DOUBLE * (SELECT n FROM n)
  ORDER BY total_tf DESC, term LIMIT 5000),
vocabulary AS (
  SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, df,
    ln((1 + n) / (1.0::DOUBLE + df)) + 1 AS idf FROM admissible, n),
raw AS (SELECT id, idx, tf * idf AS weight FROM counts JOIN vocabulary USING (term)),
weights AS (
  SELECT id, idx, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM raw)
"""


_TEXTS = f"SELECT product_id AS id, {TEXT_SQL} AS text FROM enriched"
_PRODUCT_SQL = f"WITH {PRODUCTS_SQL}, {_tfidf_sql(_TEXTS)}"
_DOCUMENT_SQL = f"WITH {_tfidf_sql('SELECT doc_id AS id, text FROM documents')}"


def _product_terms(spark: SparkSession, sf: str) -> tf.TermVectors:
    return tf.tfidf(with_product_text(enriched(spark, sf)), "product_id", "text")


def _vocabulary(text: tf.TermVectors) -> DataFrame:
    return text.vocabulary.select("term", "idx", "df", rounded("idf").alias("idf"))


def _weights(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", "idx", rounded("weight").alias("weight"))


_VOCABULARY_COLUMNS = "term, idx, df, round(idf, 6) AS idf"


@query("product_terms", f"{_PRODUCT_SQL} SELECT {_VOCABULARY_COLUMNS} FROM vocabulary")
def product_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(_product_terms(spark, sf))


@query("product_tfidf", f"{_PRODUCT_SQL} SELECT id, idx, round(weight, 6) AS weight FROM weights")
def product_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(_product_terms(spark, sf).weights)


@query("document_terms", f"{_DOCUMENT_SQL} SELECT {_VOCABULARY_COLUMNS} FROM vocabulary")
def document_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The same operator over long texts."""
    return _vocabulary(tf.tfidf(table(spark, sf, "documents"), "doc_id", "text"))


@query("document_tfidf", f"{_DOCUMENT_SQL} SELECT id, idx, round(weight, 6) AS weight FROM weights")
def document_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(tf.tfidf(table(spark, sf, "documents"), "doc_id", "text").weights)


_FLAG_TESTS = ", ".join(
    [f"contains(lower(department), '{w}')::INTEGER" for w in tf.DEPARTMENT_FLAGS]
    + [f"contains(lower(aisle), '{w}')::INTEGER" for w in tf.AISLE_FLAGS]
)


@query(
    "categorical_flags",
    f"""WITH {PRODUCTS_SQL} SELECT product_id, array_to_string([{_FLAG_TESTS}], ',') AS flags
    FROM enriched""",
)
def categorical_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = tf.categorical_flags(F.col("department"), F.col("aisle"))
    return enriched(spark, sf).select("product_id", F.array_join(flags, ",").alias("flags"))


_COMBINED_SQL = f"""{_PRODUCT_SQL},
flags AS (
  SELECT product_id AS id, unnest(range(12)) AS flag, unnest([{_FLAG_TESTS}]) AS lit FROM enriched),
flag_weights AS (
  SELECT id, ((SELECT count(*) FROM vocabulary) + flag)::INTEGER AS idx,
    1 / sqrt(sum(lit) OVER (PARTITION BY id)) AS weight FROM flags WHERE lit = 1),
both_parts AS (
  SELECT id, idx, weight * 0.8::DOUBLE AS weight FROM weights
  UNION ALL SELECT id, idx, weight * (1 - 0.8::DOUBLE) FROM flag_weights),
combined AS (
  SELECT id, idx, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight
  FROM both_parts)
"""


@query(
    "similarity_vectors", f"{_COMBINED_SQL} SELECT id, idx, round(weight, 6) AS weight FROM combined"
)
def similarity_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(tf.similarity_vectors(enriched(spark, sf))[1])


_SAMPLE_SQL = f"""{_COMBINED_SQL},
sample AS (
  SELECT product_id AS id, product_name, row_number() OVER (
    ORDER BY md5(concat_ws('|', '42', product_id)), product_id) - 1 AS sample_no
  FROM enriched ORDER BY sample_no LIMIT 1000),
picked AS (SELECT combined.* FROM combined JOIN sample USING (id)),
scores AS (
  SELECT a.id, b.id AS neighbour_id, sum(a.weight * b.weight) AS score
  FROM picked a JOIN picked b USING (idx) GROUP BY a.id, b.id),
ranked AS (
  SELECT s.id, s.sample_no, o.id AS neighbour_id, round(coalesce(score, 0), 9) AS score,
    row_number() OVER (PARTITION BY s.id
      ORDER BY round(coalesce(score, 0), 9) DESC, o.id) AS rank
  FROM sample s JOIN sample o ON o.id <> s.id
  LEFT JOIN scores ON scores.id = s.id AND scores.neighbour_id = o.id),
near AS (SELECT * FROM ranked WHERE rank <= 9)
"""


@query("random_sample", f"{_SAMPLE_SQL} SELECT id, sample_no::INTEGER AS sample_no FROM sample")
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    names = enriched(spark, sf).select(F.col("product_id").alias("id"))
    return nb.random_sample(names, "id").select("id", "sample_no")


def _neighbours(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = enriched(spark, sf)
    vectors = tf.similarity_vectors(items)[1]
    names = items.select(F.col("product_id").alias("id"), "product_name")
    sample = written(nb.random_sample(names, "id"), "sample")
    return sample, nb.sample_neighbours(vectors, sample, 9)


@query(
    "sample_neighbours",
    f"""{_SAMPLE_SQL} SELECT id, rank::INTEGER AS rank, neighbour_id, round(score, 6) AS score
    FROM near""",
)
def sample_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf)[1].select(
        "id", "rank", "neighbour_id", rounded("score").alias("score")
    )


@query(
    "similarity_statistics",
    f"""{_SAMPLE_SQL} SELECT round(avg(score), 6) AS mean_similarity,
      round(stddev_pop(score), 6) AS std_similarity,
      round(quantile_cont(score, 0.95), 6) AS p95_similarity FROM near""",
)
def similarity_statistics(spark: SparkSession, sf: str) -> DataFrame:
    stats = nb.similarity_statistics(_neighbours(spark, sf)[1])
    return stats.select(*[rounded(c).alias(c) for c in stats.columns])


@query(
    "good_examples",
    rf"""{_SAMPLE_SQL},
    named AS (
      SELECT near.sample_no, near.id, q.product_name AS query, near.rank, o.product_name AS other,
        len(list_filter(list_intersect(
            list_distinct(regexp_split_to_array(lower(q.product_name), '\s+')),
            list_distinct(regexp_split_to_array(lower(o.product_name), '\s+'))),
          lambda w: len(w) > 3 AND w NOT IN ('organic', 'natural', 'fresh', 'premium'))) AS shared
      FROM near JOIN sample q ON q.id = near.id JOIN sample o ON o.id = near.neighbour_id
      WHERE near.sample_no < 20 AND near.rank <= 5)
    SELECT id, query, sum(shared)::BIGINT AS shared, string_agg(other, '; ' ORDER BY rank) AS similar
    FROM named GROUP BY sample_no, id, query HAVING sum(shared) >= 2 ORDER BY sample_no LIMIT 5""",
)
def good_examples(spark: SparkSession, sf: str) -> DataFrame:
    sample, near = _neighbours(spark, sf)
    return nb.good_examples(near, sample).select(
        "id", "query", "shared", F.array_join(F.col("similar.neighbour"), "; ").alias("similar")
    )


_CATALOGUE_SQL = f"""{_COMBINED_SQL},
scores AS (
  SELECT a.id, b.id AS neighbour_id, round(sum(a.weight * b.weight), 9) AS score
  FROM combined a JOIN combined b ON a.idx = b.idx AND a.id <> b.id GROUP BY a.id, b.id),
near AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour_id) AS rank
  FROM scores WHERE score > 0 QUALIFY rank <= 9)
"""


def _catalogue_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = tf.similarity_vectors(enriched(spark, sf))[1]
    return cn.catalogue_neighbours(vectors.withColumn("id", F.col("id").cast("bigint")), 9)


@query(
    "catalogue_neighbours",
    f"""{_CATALOGUE_SQL} SELECT id, rank::INTEGER AS rank, neighbour_id, round(score, 6) AS score
    FROM near""",
)
def catalogue_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The nine nearest products of every product."""
    return _catalogue_neighbours(spark, sf).select(
        "id", "rank", "neighbour_id", rounded("score").alias("score")
    )


@query(
    "catalogue_similarity",
    f"""{_CATALOGUE_SQL} SELECT round(avg(score), 6) AS mean_similarity,
      round(stddev_pop(score), 6) AS std_similarity,
      round(quantile_cont(score, 0.95), 6) AS p95_similarity FROM near""",
)
def catalogue_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity report over the neighbours of the whole catalogue."""
    stats = nb.similarity_statistics(_catalogue_neighbours(spark, sf))
    return stats.select(*[rounded(c).alias(c) for c in stats.columns])


@query(
    "similarity_output",
    f"""{_COMBINED_SQL} SELECT 'product_similarity' AS embedding_type,
      'tfidf_plus_categorical' AS method, (SELECT count(*) FROM vocabulary) AS vocabulary_size,
      (SELECT count(*) + 12 FROM vocabulary) AS width, (SELECT count(*) FROM part) AS products_count,
      count(*) AS stored_weights FROM combined""",
)
def similarity_output(spark: SparkSession, sf: str) -> DataFrame:
    """The whole vector job, written and read back."""
    path = new_path(spark, "similarity")
    build_similarity_vectors(
        products(spark, sf), aisles(spark, sf), departments(spark, sf), path=path
    )
    stored = spark.read.parquet(f"{path}/vectors").count()
    return spark.read.parquet(f"{path}/metadata").withColumn(
        "stored_weights", F.lit(stored).cast("bigint")
    )
