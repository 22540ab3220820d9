"""Sources, basket tables, encoding, masking and splits."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trolley.operators import baskets as bk
from trolley.operators import encode, split, stats, vocab
from trolley.operators.position import with_key_positions, with_positions
from trolley.operators.skew import attach_by_key
from trolley.plans.jobs import prepare_sequences
from trolley.sources import tables as src

ROWS = [
    (1, "[[1, 2], [3], [1, 4], [5], [6]]", "[7, 2]"),
    (2, "[[1]]", "[2]"),
    (3, "[[], [9, 10, 11]]", "[]"),
    (4, None, "[1]"),
]


@pytest.fixture
def sequences(spark):
    df = spark.createDataFrame(
        [(row[0], *row) for row in ROWS],
        "row_idx bigint, user_id bigint, customer_sequence string, last_basket string",
    )
    return src.parse_sequences(df)


def test_resolve_columns(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["x", "Order_History", "my_target"])
    assert src.resolve_sequence_columns(df).columns == ["x", "customer_sequence", "last_basket"]
    with pytest.raises(ValueError, match="customer_sequence"):
        src.resolve_sequence_columns(df.select("x"))


def test_a_column_serves_one_name(spark):
    df = spark.createDataFrame([("a", "b")], ["basket_history", "target"])
    assert src.resolve_sequence_columns(df).columns == ["customer_sequence", "last_basket"]
    with pytest.raises(ValueError, match="last_basket"):
        src.resolve_sequence_columns(df.select("basket_history"))


def test_rows_of_a_file_stay_apart(spark):
    rows = [(0, "u7", [[1], [2, 3]], [4]), (1, "u7", [[5]], [6]), (2, "9", [[7]], [8]), (3, None, [[9]], [1])]
    df = spark.createDataFrame(
        rows, "row_idx bigint, user_id string, customer_sequence array<array<bigint>>, last_basket array<bigint>"
    )
    long = bk.baskets_from_sequences(df).long().collect()
    assert len(long) == 10
    assert {(r.user_id, r.file_user) for r in long} == {(0, "u7"), (1, "u7"), (2, "9"), (3, None)}
    alone = bk.baskets_from_sequences(df.drop("user_id")).long()
    assert {r.file_user for r in alone.collect()} == {0, 1, 2, 3}


def test_strict_parse_fails_on_bad_literal(spark):
    bad = spark.createDataFrame([("[[1, x]]", "[1]")], ["customer_sequence", "last_basket"])
    with pytest.raises(Exception, match="not a list literal"):
        src.parse_sequences(bad).collect()
    assert src.parse_sequences(bad, strict=False).first()["customer_sequence"] is None


def test_lenient_parse(spark):
    df = spark.createDataFrame(
        [("[[1, -2, x, 99999999999999999999], [3]]", "[4]"), ("[[], [5]]", "[]")], ["sequence_idx", "last_basket_idx"]
    )
    got = src.parse_sequences_lenient(df).select("customer_sequence", "last_basket").collect()
    # a leading empty basket swallows the separator, so the next one is lost as well
    assert [tuple(r) for r in got] == [([[1], [3]], [4]), ([], [])]


def test_item_vectors_skip_special_rows(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>")
    got = src.item_vectors(df).orderBy("item_id").collect()
    assert [(r.item_id, r.embedding) for r in got] == [(0, [2.0]), (1, [3.0]), (2, [4.0])]
    assert src.vector_width(df) == 1


def test_family_document(spark, tmp_path):
    doc = {
        "metadata": {"total_families": 1},
        "families": {
            "0": {
                "family_id": 0, "family_name": "Tea Family", "size": 2,
                "representative_product": "Tea", "departments": ["d"], "aisles": ["a"],
                "avg_similarity": 100.0,
                "products": [
                    {"product_id": 5, "name": "Tea", "department": "d", "aisle": "a"},
                    {"product_id": 6, "name": "Tea 2", "department": "d", "aisle": "a"},
                ],
            }
        },
    }
    path = tmp_path / "families.json"
    path.write_text(json.dumps(doc, indent=2))
    families = src.read_families(spark, str(path))
    assert families.first()["family_name"] == "Tea Family"
    members = src.family_members(families).orderBy("member_no").collect()
    assert [(m.member_no, m.product_id) for m in members] == [(0, 5), (1, 6)]


def test_padding_and_invalid_rows(spark, sequences):
    data = bk.baskets_from_sequences(sequences)
    words = vocab.vocabulary(data.items)
    rows = {
        r.user_id: r
        for r in encode.encode_sequences(data, words, max_seq=3, max_basket=2).collect()
    }
    assert set(rows) == {1, 2, 3}  # the NULL sequence is skipped
    tokens = {r.item_id: r.token_id for r in words.collect()}
    assert min(tokens.values()) == 2
    t = lambda *items: [tokens[i] for i in items]
    # the last three of five baskets
    assert rows[1].sequence == [t(1, 4), [*t(5), 0], [*t(6), 0]]
    assert rows[1].target_padded == t(7, 2)
    assert rows[1].target_tokens == sorted(t(7, 2))
    assert rows[2].sequence == [[*t(1), 0], [0, 0], [0, 0]]
    assert rows[2].sequence_mask == [1, 0, 0]
    # an empty basket is all padding, a long one is cut
    assert rows[3].sequence == [[0, 0], t(9, 10), [0, 0]]
    assert rows[3].basket_mask == [[0, 0], [1, 1], [0, 0]]
    assert (rows[3].target_padded, rows[3].target_tokens) == ([0, 0], [])


def test_target_set_is_whole_when_baskets_are_cut(spark, sequences):
    data = bk.baskets_from_sequences(sequences)
    words = vocab.vocabulary(data.items)
    row = encode.encode_sequences(data, words, max_basket=1).where("user_id = 1").first()
    assert len(row.target_padded) == 1 and len(row.target_tokens) == 2


def test_masking(spark, sequences):
    data = bk.baskets_from_sequences(sequences)
    encoded = encode.encode_sequences(data, vocab.vocabulary(data.items), max_seq=5)
    for row in encode.mask_baskets(encoded, prob=0.5).collect():
        n = sum(row.sequence_mask)
        wanted = max(1, int(n * 0.5)) if n > 1 else 0
        assert len(row.masked_positions) == len(row.masked_labels) == wanted
        assert row.masked_positions == sorted(set(row.masked_positions))
        for i, basket in enumerate(row.masked_sequence):
            if i in row.masked_positions:
                assert set(basket) == {1}
                assert row.masked_labels[row.masked_positions.index(i)] == row.sequence[i]
            else:
                assert basket == row.sequence[i]


@pytest.mark.parametrize("n,fraction", [(1, 0.2), (7, 0.2), (1000, 0.2), (333, 0.05), (10, 0.0)])
def test_split_sizes_are_exact(spark, n, fraction):
    df = spark.range(n).withColumnRenamed("id", "user_id")
    got = split.assign_split(df, val_fraction=fraction)
    assert got.count() == n
    assert got.where("split = 'val'").count() == math.ceil(n * fraction)


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "user_id")
    a = split.assign_split(df.repartition(7)).where("split = 'val'").collect()
    b = split.assign_split(df.coalesce(1)).where("split = 'val'").collect()
    assert sorted(a) == sorted(b)


def test_stratified_sample_keeps_shares(spark):
    # one stratum holds most of the rows
    df = spark.range(3000).select("id", F.when(F.col("id") < 2700, 0).otherwise(F.col("id") % 3).alias("s"))
    got = {r.s: r["count"] for r in split.stratified_sample(df, "s", "id", 500).groupBy("s").count().collect()}
    sizes = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert got == {s: -(-n * 500 // 3000) for s, n in sizes.items()}


def test_histogram_of_constant(spark):
    rows = stats.histogram(spark.createDataFrame([(3,), (3,)], "n int"), "n").collect()
    assert len(rows) == 20
    assert {r.bin: r.n for r in rows if r.n} == {10: 2}


def test_positions_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v"))
    got = with_positions(df.repartition(5), ["k"], "pos", start=3).collect()
    assert sorted((r.pos, r.k) for r in got) == [(i + 3, i) for i in range(1000)]


def test_key_positions_with_one_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"),
        (-F.col("id")).alias("at"),
    )
    got = with_key_positions(df, ["key"], ["at"], "n", "rows").where("key = -1").collect()
    assert [r.n for r in sorted(got, key=lambda r: r["at"])] == list(range(len(got)))
    assert {r.rows for r in got} == {len(got)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_by_key_equals_join(spark, how):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("k"), "id"
    )
    stats_ = df.where("k <> 7").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = attach_by_key(df, stats_, ["k"], "n", how)
    want = df.join(stats_, ["k"], how)
    assert got.exceptAll(want.select(got.columns)).isEmpty()
    assert got.count() == want.count()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("total", [3, 499, 500, 501])
def test_attach_by_key_keeps_single_rows(spark, how, total):
    df = spark.range(total).select(F.when(F.col("id") < total // 2, 0).otherwise(F.col("id")).alias("k"), "id")
    stats_ = df.groupBy("k").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("k") % 5 != 4, F.col("n")))
    assert attach_by_key(df, stats_, ["k"], "n", how).count() == total


def test_prepared_files(spark, sequences, tmp_path):
    done = prepare_sequences(
        bk.baskets_from_sequences(sequences), max_seq=4, path=str(tmp_path / "out")
    )
    meta = spark.read.parquet(str(tmp_path / "out" / "metadata")).first()
    assert (meta.num_train, meta.num_val) == (2, 1)
    assert meta.vocab_size == done.vocab.count() + 2
    assert meta.max_basket_size == 3


def test_a_huge_basket_widens_only_its_own_row(spark, tmp_path):
    """One basket of 100,000 items: stored rows of others stay small, padding waits for the reader."""
    small = [(u, b, u * 10 + b, u * 7 + i) for u in range(1, 6) for b in range(3) for i in range(u)]
    lines = spark.createDataFrame([(o, p) for _, _, o, p in small], "l_orderkey bigint, l_partkey bigint").unionByName(
        spark.range(100_000).selectExpr("900L AS l_orderkey", "id AS l_partkey")
    )
    orders = spark.createDataFrame([(o, u, b) for u, b, o, _ in {(u, b, o, 0) for u, b, o, _ in small}] + [(900, 9, 0), (11, 9, 1)],
                                   "o_orderkey bigint, o_custkey bigint, d int")
    orders = orders.dropDuplicates(["o_orderkey"]).selectExpr("o_orderkey", "o_custkey", "timestamp_seconds(d * 86400) AS o_orderdate")
    path = str(tmp_path / "out")
    prepare_sequences(bk.baskets_from_orders(orders, lines), max_seq=2, path=path)
    ragged = src.read_ragged(spark, path)
    sizes = {r.user_id: r.n for r in ragged.selectExpr("user_id", "aggregate(baskets, 0, (a, b) -> a + size(b)) + size(target) AS n").collect()}
    assert max(n for u, n in sizes.items() if u != 9) <= 15 and sizes[9] >= 100_000
    padded = src.read_prepared(spark, path)
    row = padded.where("user_id = 3").select("sequence", "target_padded", "sequence_mask").first()
    assert [len(b) for b in row.sequence] == [100_000] * 2 and len(row.target_padded) == 100_000
    assert sum(x != 0 for x in row.target_padded) == 3 and row.sequence_mask == [1, 1]
    plan = padded.select("target_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "baskets" not in plan.split("ReadSchema: ")[1].splitlines()[0]


def test_reader_gives_the_padded_rows(spark, sequences, tmp_path):
    path = str(tmp_path / "out")
    done = prepare_sequences(bk.baskets_from_sequences(sequences), max_seq=4, max_basket=2, path=path)
    columns = ["user_id", "sequence", "sequence_mask", "basket_mask", "target_padded", "target_tokens", "masked_sequence", "masked_labels", "split"]
    stored = src.read_prepared(spark, path).select(*columns)
    encoded = encode.mask_baskets(encode.encode_sequences(bk.baskets_from_sequences(sequences), done.vocab, 4, 2))
    assert sorted(stored.collect()) == sorted(done.rows.select(*columns).collect())
    assert sorted(stored.drop("split").collect()) == sorted(encoded.select(*columns[:-1]).collect())


def test_large_family_documents_are_cut_by_many_tasks(spark, tmp_path):
    families = {
        str(i): {
            "family_id": i, "family_name": f'say "family_id": {i} }}, {{', "size": 2,
            "representative_product": "\u00e9\u6f22 " * (i % 40), "departments": ["a", "b"], "aisles": [],
            "avg_similarity": 91.5,
            "products": [
                {"product_id": i + k, "name": "family_id", "department": "{", "aisle": "}"} for k in range(i % 5)
            ],
        }
        for i in range(500)
    }
    doc = {"metadata": {"total": 500, "of": {"y": 1}}, "families": families}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "many.json").write_text(json.dumps(doc, indent=2, ensure_ascii=False))
    (tmp_path / "none.json").write_text(json.dumps({"metadata": {}, "families": {}}))
    (tmp_path / "other.json").write_text('{"families": {"0": {"size": 2, "family_id": 0}}}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for name in ("one.json", "many.json"):
            path = str(tmp_path / name)
            cut = src.read_large_families(spark, path)
            assert cut.rdd.getNumPartitions() > 3
            assert sorted(map(str, cut.collect())) == sorted(map(str, src.read_families(spark, path).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert src.read_large_families(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception, match="first key"):
        src.read_large_families(spark, str(tmp_path / "other.json")).collect()
