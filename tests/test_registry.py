"""The driver contract, and a part of the registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_module
import verify

CHECKED = [
    "basket_long_form", "vocabulary", "basket_statistics", "encoded_sequences", "masked_sequences",
    "train_val_split", "csv_sequences_lenient", "product_texts", "key_terms", "candidate_pairs_50",
    "family_members_50", "family_summary", "similarity_vectors", "composite_vectors", "silhouette",
    "evaluation_cases", "nearest_list_metrics",
]


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in verify.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, sf, name):
    line = verify.compare(spark, db, name, sf)
    assert line.startswith("OK") and "types" not in line, line


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["family_id", "family_name"] and not df.isEmpty()


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
