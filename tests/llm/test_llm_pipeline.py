"""The pipeline's stages and the registration of the queries."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
import verify


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.dtypes
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        assert docs.dtypes == columns
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]
    assert docs.where("text IS NOT NULL AND n_chars <> length(text)").isEmpty()


def test_whole_texts_reach_the_workers_in_small_batches(spark):
    corpus_pipeline.prepare(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    texts = spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 4000) as text")
    found = [r["size"] for r in texts.mapInArrow(sizes, "size long").collect()]
    assert sum(found) >= 24e6 and max(found) < 6e6


def test_run_returns_pieces(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_all_queries_are_registered():
    names = entry_module.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op4_source_mixing"])
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in verify.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    line = verify.compare(spark, db, name, sf)
    assert line.startswith("OK") and "types" not in line, line
