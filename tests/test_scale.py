"""Hot keys end to end, and the shape of the physical plans."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from trolley.operators import encode, vocab
from trolley.operators.baskets import baskets_from_orders
from trolley.operators.families import fuzzy_families
from trolley.operators import ranking as rk
from trolley.operators.ranking import evaluation_cases, sample_candidates
from trolley.storage import balanced


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the orders by one customer, a third of the lines one item, one huge order."""
    orders = spark.range(3000).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 97 + 2).alias("o_custkey"),
        F.timestamp_seconds(F.col("id") * 7919 % 3000 * 86400).alias("o_orderdate"),
    )
    lines = spark.range(12000).select(
        F.when(F.col("id") % 5 == 0, 7).otherwise(F.col("id") % 3000).alias("l_orderkey"),
        F.when(F.col("id") % 3 == 0, 11).otherwise(F.col("id") * 31 % 800).alias("l_partkey"),
    )
    return orders, lines


def test_skewed_baskets_are_whole(spark, skewed):
    orders, lines = skewed
    data = baskets_from_orders(orders, lines)
    got = {
        (r.user_id, r.basket_pos): r.basket_id
        for r in data.headers.select("user_id", "basket_pos", "basket_id").collect()
    }
    filled = {r.l_orderkey for r in lines.select("l_orderkey").distinct().collect()}
    by_user = {}
    for r in orders.collect():
        if r.o_orderkey in filled:
            by_user.setdefault(r.o_custkey, []).append((r.o_orderdate, r.o_orderkey))
    want = {
        (user, i): key
        for user, own in by_user.items()
        for i, (_, key) in enumerate(sorted(own))
    }
    assert got == want
    pairs = {(r.l_orderkey, r.l_partkey) for r in lines.distinct().collect()}
    long = {(r.basket_id, r.item_id) for r in data.long().select("basket_id", "item_id").collect()}
    assert long == pairs
    words = vocab.vocabulary(data.items)
    assert words.agg(F.sum("frequency")).first()[0] == len(pairs)
    encoded = encode.encode_sequences(data, words, max_seq=5, max_basket=3)
    row = encoded.where("user_id = 1").first()
    assert len(row.sequence) == 5 and all(len(b) == 3 for b in row.sequence)
    assert encoded.count() == len(by_user)


def test_skewed_evaluation(spark, skewed):
    found = evaluation_cases(baskets_from_orders(*skewed))
    items = spark.range(800).withColumnRenamed("id", "item_id")
    inline = sample_candidates(found, items, n=20)
    joined = sample_candidates(found, items, n=20, inline_history=3)
    assert inline.exceptAll(joined).isEmpty() and joined.exceptAll(inline).isEmpty()
    assert inline.count() == found.cases.where("history_size + 21 <= 800").count()


def test_one_name_for_a_third_of_the_catalogue(spark):
    products = spark.range(900).select(
        F.col("id").alias("product_id"),
        F.when(F.col("id") % 3 == 0, "same old thing")
        .otherwise(F.concat(F.lit("thing "), F.md5(F.col("id").cast("string"))))
        .alias("product_name"),
        F.lit("d").alias("department"),
        F.lit("a").alias("aisle"),
    )
    found = fuzzy_families(products, max_size=7, block_rows=120, fanout=2)
    sizes = [r.size for r in found.families.orderBy("family_id").collect()]
    # 300 equal names in a row make 42 full families and one of the six left over
    assert sizes == [7] * 42 + [6]


def test_encode_ranks_before_the_shuffle(spark, sf):
    orders, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    data = baskets_from_orders(orders, lines)
    tokens = encode.token_baskets(data, vocab.vocabulary(data.items), 5)
    plan = plan_of(tokens)
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize(
    "name",
    ["encoded_sequences", "family_summary", "family_separation", "similarity_vectors",
     "calinski_harabasz", "ranks_embedding_joined", "nearest_list_metrics"],
)
def test_no_nested_loops(spark, sf, name):
    plan = plan_of(entry_module.queries()[name](spark, sf))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_only_needed_columns(spark, sf):
    plan = plan_of(entry_module.queries()["top_items"](spark, sf))
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert schema == "struct<l_orderkey:bigint,l_partkey:bigint>"


def test_scores_in_cells_are_those_of_the_shared_matrix(spark, skewed):
    """One customer with a third of all cases, blocks of a few items, gaps in the vectors."""
    found = evaluation_cases(baskets_from_orders(*skewed))
    parts = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i + i))
    vectors = spark.range(800).where("id % 7 <> 3").select(F.col("id").alias("item_id"), parts.alias("embedding"))
    history = found.history.where("user_id <> 5")
    cases = sample_candidates(found, spark.range(800).withColumnRenamed("id", "item_id"), n=20)
    whole = rk.rank_embedding(history, vectors)(cases)
    cells = rk.rank_embedding(history, vectors, limit_bytes=0, cell_bytes=3000)(cases)
    plan = plan_of(cells)
    assert "FlatMapCoGroupsInArrow" in plan
    a, b = ({(r.user_id, r.positive_item): r for r in rows.collect()} for rows in (whole, cells))
    assert a.keys() == b.keys()
    for key, row in a.items():
        assert row.candidates == b[key].candidates and row.scores == pytest.approx(b[key].scores)


def test_times_in_place_are_those_of_the_join(spark, skewed):
    found = evaluation_cases(baskets_from_orders(*skewed))
    cases = sample_candidates(found, spark.range(800).withColumnRenamed("id", "item_id"), n=20)
    bought = found.usage.select("user_id", "item_id", F.lit(2).alias("times"))
    got = [rk.rank_frequency(bought, inline_history=n)(cases).select("user_id", "positive_item", "scores") for n in (5_000, 12, 0)]
    assert got[0].exceptAll(got[1]).isEmpty() and got[0].exceptAll(got[2]).isEmpty()
    assert got[0].count() == got[1].count() == got[2].count() == cases.count()
    assert got[0].where("scores[0] = 0").isEmpty()


def test_histories_do_not_travel_beside_cases(spark, skewed):
    """No exchange carries both a case's positive and the blocked places of its user."""
    found = evaluation_cases(baskets_from_orders(*skewed))
    blocked = found.history.groupBy("user_id").agg(F.collect_list("item_id").alias("blocked"), F.count("*").alias("n_cases"))
    cases = found.cases.withColumn("positive_pos", F.col("positive_item"))
    plan = rk._inline_negatives(cases, blocked, rk.DrawStream(800, 20, 1.3, 1))._jdf.queryExecution()
    formatted = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = [e for e in formatted.split("\n\n") if "Exchange" in e.split("\n")[0]]
    inputs = [e.split("Input")[1].splitlines()[0] for e in exchanges if "Input" in e]
    assert inputs and not any("blocked" in i and "positive_item" in i for i in inputs)


def test_no_task_counts_the_terms_of_many_texts(spark):
    """Texts in few large partitions are dealt again, those in many stay where they are."""
    few, rows = balanced(spark.range(0, 9000, 1, 4), "id", most=1000)
    assert rows == 9000 and few.rdd.getNumPartitions() == 9 and few.distinct().count() == 9000
    many, _ = balanced(spark.range(0, 9000, 1, 40), "id", most=1000)
    assert many.rdd.getNumPartitions() == 40 and "Exchange" not in plan_of(many)


def test_ranks_come_in_parts_that_leave_nothing_behind(spark, skewed):
    """Candidates and cells of a part go before the next begins; a user with a third of all cases is dealt to all parts."""
    found = evaluation_cases(baskets_from_orders(*skewed))
    parts = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i + i))
    vectors = spark.range(800).where("id % 7 <> 3").select(F.col("id").alias("item_id"), parts.alias("embedding"))
    items = spark.range(800).withColumnRenamed("id", "item_id")
    whole = rk.positive_ranks(rk.rank_embedding(found.history, vectors)(sample_candidates(found, items)))
    cut = rk.evaluation_parts(found, 200)
    sizes = [part.cases.count() for part in cut]
    assert len(sizes) > 3 and sum(sizes) == found.cases.count() and max(sizes) < 400

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    alive = []

    def ranker_of(part):
        alive.append(len([f for f in folder.iterdir() if f.name.startswith("candidates")]))
        return rk.rank_embedding(part.history, vectors, limit_bytes=0, cell_bytes=3000)

    before = {f.name for f in folder.iterdir()}
    got = rk.ranks_in_parts(found, items, ranker_of, most=200)
    left = [f.name for f in folder.iterdir() if f.name not in before]
    assert len(left) == len(sizes) and all(name.startswith("ranks-") for name in left)
    assert len(set(alive)) == 1
    assert got.exceptAll(whole).isEmpty() and got.count() == whole.count()


def test_joined_ranks_keep_only_ranks(spark, sf):
    """Baskets, cases, places and candidates are gone when the query returns, and its shuffles with their actions."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    for name, twin in (("ranks_embedding_joined", "ranks_embedding"), ("ranks_embedding_gaps_joined", "ranks_embedding_gaps")):
        before = {f.name for f in folder.iterdir()}
        got = entry_module.queries()[name](spark, sf)
        left = [f.name for f in folder.iterdir() if f.name not in before]
        assert left and all(f.startswith("ranks-") for f in left)
        want = entry_module.queries()[twin](spark, sf)
        assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 0


def test_one_block_of_items_scores_lists_where_they_arrive(spark, skewed):
    """With one block of items there is no second shuffle of the candidates and no join."""
    found = evaluation_cases(baskets_from_orders(*skewed))
    parts = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i + i))
    vectors = spark.range(800).where("id % 7 <> 3").select(F.col("id").alias("item_id"), parts.alias("embedding"))
    history = found.history.where("user_id <> 5")
    cases = sample_candidates(found, spark.range(800).withColumnRenamed("id", "item_id"), n=20)
    scored = rk.rank_embedding(history, vectors, limit_bytes=0)(cases)
    tail = plan_of(scored).split("FlatMapCoGroupsInArrow")[0]
    assert "Join" not in tail and "Exchange" not in tail
    whole = {(r.user_id, r.positive_item): r for r in rk.rank_embedding(history, vectors)(cases).collect()}
    rows = scored.collect()
    assert len(rows) == len(whole)
    for row in rows:
        want = whole[row.user_id, row.positive_item]
        assert row.candidates == want.candidates and row.scores == pytest.approx(want.scores)
    none = rk.rank_embedding(history, vectors.limit(0), limit_bytes=0)(cases)
    assert none.count() == len(whole) and none.where("exists(scores, x -> x <> 0)").isEmpty()
