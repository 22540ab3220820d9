"""Evaluation cases, negatives, rankers and list metrics."""

import math
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trolley.operators import baskets as bk
from trolley.functions.hashing import hash_to_long, keyed_hash, numbered_longs
from trolley.operators import metrics as mt
from trolley.operators import ranking as rk


def from_rows(spark, rows):
    df = spark.createDataFrame(
        [(u, u, s, t) for u, s, t in rows],
        "row_idx bigint, user_id bigint, customer_sequence array<array<bigint>>, last_basket array<bigint>",
    )
    return bk.baskets_from_sequences(df)


@pytest.fixture(scope="module")
def crowd(spark):
    """Thirty users; one of them has bought far more than the others."""
    rng = random.Random(5)
    rows = []
    for user in range(30):
        n = 60 if user == 0 else rng.randint(2, 6)
        rows.append(
            (user, [[rng.randrange(400) for _ in range(3)] for _ in range(n)], [rng.randrange(400)])
        )
    return from_rows(spark, rows)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame(
        [(i, [float(v) for v in rng.normal(size=8)]) for i in range(400)],
        "item_id bigint, embedding array<double>",
    ).persist()


def test_cases_of_the_fixture(spark):
    data = from_rows(spark, [(1, [[1, 2], [3], [1, 4], [5], [6]], [7, 2]), (2, [[1]], [2]), (3, [[], [9], [8]], [4])])
    found = rk.evaluation_cases(data)
    assert sorted((r.user_id, r.positive_item, r.history_size) for r in found.cases.collect()) == [
        (1, 6, 5), (1, 7, 5), (3, 4, 1), (3, 8, 1),
    ]
    assert rk.leakage_count(found).first()[0] == 1
    assert {r.item_id for r in found.history.where("user_id = 1").collect()} == {1, 2, 3, 4, 5}


def test_no_leakage_and_disjoint_negatives(spark, crowd, vectors):
    found = rk.evaluation_cases(crowd, vectors)
    assert found.cases.join(
        found.history.withColumnRenamed("item_id", "positive_item"), ["user_id", "positive_item"]
    ).isEmpty()
    got = rk.sample_candidates(found, vectors)
    assert got.count() == found.cases.count()
    flat = got.select("user_id", "positive_item", F.posexplode("candidates").alias("k", "item_id"))
    negatives = flat.where("k > 0")
    assert negatives.where("item_id = positive_item").isEmpty()
    assert negatives.join(found.history, ["user_id", "item_id"], "left_semi").isEmpty()
    sizes = negatives.groupBy("user_id", "positive_item").agg(F.countDistinct("item_id").alias("n"))
    assert {r.n for r in sizes.collect()} == {99}


def test_both_paths_and_partitionings_agree(spark, crowd, vectors):
    found = rk.evaluation_cases(crowd, vectors)
    inline = rk.sample_candidates(found, vectors)
    joined = rk.sample_candidates(found, vectors, inline_history=0)
    assert inline.exceptAll(joined).isEmpty() and joined.exceptAll(inline).isEmpty()


def test_scarce_catalogue(spark):
    """Few free items: the stream is read again and further; too few free items: skipped."""
    rows = [(1, [[0, 1, 2], [3]], [50]), (2, [list(range(45)), [0]], [50])]
    items = spark.createDataFrame([(10 * i,) for i in range(60)], "item_id bigint")
    scaled = [(u, [[10 * x for x in b] for b in s], [10 * x for x in t]) for u, s, t in rows]
    found = rk.evaluation_cases(from_rows(spark, scaled), items)
    got = rk.sample_candidates(found, items, n=54)
    users = {r.user_id: r.candidates for r in got.collect() if r.positive_item == 500}
    assert set(users) == {1}
    assert len(set(users[1])) == 55 and all(c % 10 == 0 for c in users[1])
    assert rk.skipped_cases(found, items, 54).first()[0] >= 1


def test_shared_and_joined_scores_agree(spark, crowd, vectors):
    found = rk.evaluation_cases(crowd, vectors)
    candidates = rk.sample_candidates(found, vectors)
    a = rk.positive_ranks(rk.rank_embedding(found.history, vectors)(candidates))
    b = rk.positive_ranks(rk.rank_embedding(found.history, vectors, limit_bytes=0)(candidates))
    assert sorted(a.collect()) == sorted(b.collect())


def test_random_ranker_is_uniform(spark, vectors):
    rng = random.Random(9)
    rows = [(u, [[rng.randrange(400)] for _ in range(5)], rng.sample(range(400), 20)) for u in range(100)]
    found = rk.evaluation_cases(from_rows(spark, rows), vectors)
    report = rk.evaluate(rk.sample_candidates(found, vectors), {"random": rk.rank_random()}).first()
    assert report.total_tests > 1500
    assert abs(report.hit_rate - 0.1) < 0.03 and abs(report.avg_rank - 50.5) < 3


def test_frequency_ranker_counts_and_falls_back_to_id(spark):
    candidates = spark.createDataFrame(
        [(1, 5, [5, 2, 9]), (2, 5, [5, 2, 9])], "user_id bigint, positive_item bigint, candidates array<bigint>"
    )
    purchases = spark.createDataFrame([(1, 5, 3), (1, 9, 1)], "user_id bigint, item_id bigint, times bigint")
    ranks = rk.positive_ranks(rk.rank_frequency(purchases)(candidates)).collect()
    assert {r.user_id: r["rank"] for r in ranks} == {1: 1, 2: 2}


def test_compare_flags(spark):
    rows = [("random", 0.1), ("frequency", 0.01), ("embedding", 0.4), ("reduced", 0.2)]
    got = {
        r.method: r
        for r in rk.compare(spark.createDataFrame(rows, "method string, hit_rate double")).collect()
    }
    assert {m: r.verdict for m, r in got.items()} == {
        "random": "correct", "frequency": "correct", "embedding": "moderate", "reduced": "low",
    }
    assert got["random"].best_embedding == "embedding" and got["random"].overall == "good"
    assert got["random"].retention_percent == pytest.approx(50.0)
    assert [r.method for r in sorted(got.values(), key=lambda r: r.place)] == [
        "embedding", "reduced", "random", "frequency",
    ]


def test_list_metrics(spark):
    recommended = spark.createDataFrame(
        [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (2, 13, 2), (2, 14, 3)],
        "user_id bigint, item_id bigint, rank int",
    )
    relevant = spark.createDataFrame(
        [(1, 11), (1, 12), (1, 99), (2, 98)], "user_id bigint, item_id bigint"
    )
    rows = {r.k: r for r in mt.ranking_metrics(recommended, relevant, [1, 2, 3]).collect()}
    assert rows[1].precision == rows[1].hit == 0
    assert rows[2].recall == pytest.approx((1 / 3 + 0) / 2)
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert rows[3].ndcg == pytest.approx(dcg / ideal / 2)
    assert rows[3].mrr == pytest.approx(0.25)
    assert mt.item_coverage(recommended, 10).first().item_coverage == 0.5
    share = [2 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 6]
    assert mt.recommendation_entropy(recommended).first()[0] == pytest.approx(
        -sum(p * math.log2(p) for p in share)
    )


def test_nearest_items_in_blocks(spark, crowd, vectors):
    found = rk.evaluation_cases(crowd, vectors)
    profiles = rk.user_profiles(found.history, vectors)
    whole = mt.recommend_nearest(profiles, vectors, 7)
    blocks = mt.recommend_nearest(profiles, vectors, 7, block_bytes=5000)
    assert sorted(whole.collect()) == sorted(blocks.collect())
    local = {r.user_id: np.array(r.profile) for r in profiles.collect()}
    matrix = np.array([r.embedding for r in vectors.orderBy("item_id").collect()])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    for user in (0, 3):
        want = np.argsort(-(unit @ local[user]), kind="stable")[:7].tolist()
        got = whole.where(F.col("user_id") == user).orderBy("rank").collect()
        assert [r.item_id for r in got] == want


def test_nearest_items_stay_on_executors(spark, crowd, vectors):
    found = rk.evaluation_cases(crowd, vectors)
    profiles = rk.user_profiles(found.history, vectors)
    nearest = mt.recommend_nearest(profiles, vectors, 7, block_bytes=5000)
    plan = nearest._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "WindowGroupLimit" in plan and "Broadcast" not in plan
    blank = vectors.select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("embedding")).alias("embedding"))
    odd = mt.recommend_nearest(profiles.unionByName(profiles.limit(1).selectExpr("-1L AS user_id", "cast(NULL AS array<double>) AS profile")), blank, 3)
    assert odd.where("item_id % 2 = 1 OR user_id = -1").isEmpty() and odd.count() == 3 * profiles.count()
    assert mt.recommend_nearest(profiles.limit(0), vectors, 3).isEmpty()


def test_items_and_users_without_vectors(spark):
    """Candidates and profiles without a vector score zero, on both paths."""
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 1.0]), (9, [-1.0, 0.0])], "item_id bigint, embedding array<double>"
    )
    history = spark.createDataFrame([(1, 0), (2, 77)], "user_id bigint, item_id bigint")
    candidates = spark.createDataFrame(
        [(1, 2, [2, 0, 9, 1]), (1, 50, [50, 9, 0]), (2, 5, [5, 0, 9, 3])],
        "user_id bigint, positive_item bigint, candidates array<bigint>",
    )
    for limit in (rk.SHARED_MATRIX_BYTES, 0):
        ranked = rk.positive_ranks(rk.rank_embedding(history, vectors, limit_bytes=limit)(candidates))
        got = {(r.user_id, r.positive_item): r["rank"] for r in ranked.collect()}
        assert got == {(1, 2): 3, (1, 50): 2, (2, 5): 3}


def test_foreign_items_block_nothing(spark):
    items = spark.createDataFrame([(i,) for i in range(25)], "item_id bigint")
    rows = [(1, [list(range(100, 130)), [0, 1]], [2, 200])]
    found = rk.evaluation_cases(from_rows(spark, rows))
    got = {r.positive_item: r.candidates for r in rk.sample_candidates(found, items, n=10).collect()}
    assert {len(set(c)) for c in got.values()} == {11} and 200 in got
    assert rk.skipped_cases(found, items, 10).first()[0] == 0


def test_draws_in_arrays_are_those_of_the_expression(spark):
    """The hashes of a batch are Spark's, for keys of any length; long messages too."""
    for seed in (4, 42, 10**50):
        rows = spark.createDataFrame([(7, 5), (123456789, -4)], "user_id bigint, positive_item bigint")
        want = rows.select(
            F.transform(F.sequence(F.lit(95), F.lit(1004)), lambda k: hash_to_long(keyed_hash(seed, "user_id", "positive_item", k))).alias("x")
        ).collect()
        for row, (user, item) in zip(want, [(7, 5), (123456789, -4)]):
            prefix = np.frombuffer(f"{seed}|{user}|{item}|".encode(), np.uint8)
            assert numbered_longs(prefix[None], 95, 910)[0].tolist() == row.x


def test_candidates_drawn_as_they_are_read(spark, crowd, vectors):
    """Same candidates without a copy on disk, with facts of their user; no draw is spent on a margin."""
    found = rk.evaluation_cases(crowd, vectors)
    kept = rk.sample_candidates(found, vectors)
    profiles = rk.packed_profiles(rk.user_profiles(found.history, vectors))
    drawn = rk.sample_candidates(found, vectors, facts=profiles, keep=False)
    assert drawn.drop("profile").exceptAll(kept).isEmpty() and drawn.count() == kept.count()
    assert "MapInArrow" in drawn._jdf.queryExecution().executedPlan().toString()
    long = rk.sample_candidates(found, vectors, inline_history=0, facts=profiles, keep=False)
    assert long.exceptAll(drawn).isEmpty() and long.count() == drawn.count()
    assert spark.range(1).select(F.lit(30).alias("history_size")).select(rk.DrawStream(100_000, 99, 1.0, 1).length()).first()[0] <= 105
    ranks = [rk.positive_ranks(rk.rank_embedding(found.history, vectors)(c)) for c in (kept, drawn)]
    assert ranks[0].exceptAll(ranks[1]).isEmpty()


def test_scores_gather_vectors_for_a_few_cases_at_a_time():
    """A batch of ten thousand cases takes no memory for all their candidates' vectors."""
    ids, unit = np.arange(2000), np.ones((2000, 64))
    lists = pa.array([[1] * 100] * 10_000, pa.list_(pa.int64()))
    user = pa.array(np.arange(10_000))
    profiles = pa.array([[1.0] * 64] * 10_000, pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([user, user, lists, profiles], names=["user_id", "positive_item", "candidates", "profile"])
    score = rk._score_in_batches(SimpleNamespace(value=(ids, unit)))
    tracemalloc.start()
    rows = sum(out.num_rows for out in score(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 and peak < 100_000_000


def test_cells_send_vectors_to_few_blocks(spark, crowd, vectors):
    """Candidates travel as one row per case and block of items, not one each."""
    found = rk.evaluation_cases(crowd, vectors)
    candidates = rk.sample_candidates(found, vectors)
    some = vectors.where("item_id < 40")
    cells = rk.rank_embedding(found.history, some, limit_bytes=0, cell_bytes=700)(candidates)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan.lower() and "FlatMapCoGroupsInArrow" in plan
    whole = rk.rank_embedding(found.history, some)(candidates)
    a, b = (rk.positive_ranks(x) for x in (whole, cells))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def test_nearest_items_in_tiles(monkeypatch):
    """Tiles of items give the best of all, ties by id, and hold only a tile of scores."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (500, 3)).astype(np.float32)
    profiles = rng.integers(-2, 3, (40, 3)).astype(float)
    ids = rng.permutation(500)
    items = pa.table({"item_id": ids, "v": pa.array(vectors.tolist(), pa.list_(pa.float32()))})
    users = pa.table({"user_id": np.arange(40), "profile": pa.array(profiles.tolist(), pa.list_(pa.float64()))})
    scores = np.round(rk.unit_rows(profiles) @ rk.unit_rows(vectors.astype(float)).T, mt.SCORE_DIGITS)
    for k in (1, 7, 50, 600):
        want = [[int(ids[j]) for j in np.lexsort((ids, -row))[:k]] for row in scores]
        for tile in (3, 64, 4096):
            monkeypatch.setattr(mt, "ITEMS_AT_ONCE", tile)
            got = mt._best_of_cell(k)(items, users).to_pydict()
            assert got["item_id"] == [i for row in want for i in row] and got["user_id"] == [u for u, row in enumerate(want) for _ in row]
    monkeypatch.setattr(mt, "ITEMS_AT_ONCE", 1000)
    many = pa.table({"item_id": np.arange(50_000), "v": pa.array(rng.normal(size=(50_000, 3)).tolist(), pa.list_(pa.float64()))})
    tracemalloc.start()
    mt._best_of_cell(5)(many, users)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000


def test_shared_vectors_of_floats_stay_floats(spark):
    # every task holds a copy of them
    rows = [(i, [float(i), 1.0, -2.0]) for i in range(50)] + [(50, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "item_id bigint, embedding array<float>")
    ids, values = rk.shared_matrix(vectors, "embedding", 1 << 20).value
    assert values.dtype == np.float32 and ids.tolist() == list(range(51))
    assert values.tolist() == [v for _, v in rows]
    history = spark.createDataFrame([(1, 7)], "user_id bigint, item_id bigint")
    lists = spark.createDataFrame([(1, 3, [3, 7, 50, 99])], "user_id bigint, positive_item bigint, candidates array<bigint>")
    (scored,) = rk.rank_embedding(history, vectors)(lists).collect()
    near = np.dot([3, 1, -2], [7, 1, -2]) / np.sqrt(14 * 54)
    assert scored.scores == pytest.approx([near, 1.0, 0.0, 0.0])


def listed(ids, values, names, kind):
    return pa.table({names[0]: pa.array(ids, pa.int64()), names[1]: pa.array(values.tolist(), pa.list_(kind))})


def test_scores_closer_than_floats_are_told_apart(monkeypatch):
    """Products are of floats; what may be among the best is scored in doubles."""
    monkeypatch.setattr(mt, "ITEMS_AT_ONCE", 64)
    angle = np.random.default_rng(1).permutation(300) * 1e-9
    vectors = np.stack([np.cos(0.3 + angle), np.sin(0.3 + angle)], axis=1)
    items, users = listed(np.arange(300), vectors, ["item_id", "v"], pa.float64()), listed([9], np.array([[1.0, 0.0]]), ["user_id", "profile"], pa.float64())
    got = mt._best_of_cell(20)(items, users).to_pydict()
    assert got["item_id"] == np.argsort(angle)[:20].tolist()


def test_cells_rank_lists_of_odd_rows(monkeypatch):
    """Equal and repeated items, users who come twice or without an id; no score is left out by a tile."""
    monkeypatch.setattr(mt, "ITEMS_AT_ONCE", 40)
    monkeypatch.setattr(mt, "USERS_AT_ONCE", 3)
    rng = np.random.default_rng(8)
    vectors = rng.integers(-1, 2, (200, 3)).astype(np.float32)
    item_ids = [None, *rng.integers(0, 150, 199).tolist()]
    profiles = rng.integers(-2, 3, (7, 3)).astype(float)
    user_ids = [4, None, 2, 4, 7, None, 1]
    items = listed(item_ids, vectors, ["item_id", "v"], pa.float32())
    users = listed(user_ids, profiles, ["user_id", "profile"], pa.float64())
    scores = np.round(rk.unit_rows(profiles) @ rk.unit_rows(vectors.astype(float)).T, mt.SCORE_DIGITS)
    for k in (1, 13, 500):
        got = mt._best_of_cell(k, ranked=True)(items, users).to_pylist()
        assert len(got) == sum(min(k, 200 * user_ids.count(u)) for u in set(user_ids))
        for user in set(user_ids):
            every = []
            for i in (i for i, u in enumerate(user_ids) if u == user):
                # a cell keeps k for each of a user's profiles
                mine = sorted((-s, -1 if x is None else x) for s, x in zip(scores[i].tolist(), item_ids))
                every += mine[:k]
            want = [None if x == -1 else x for _, x in sorted(every)[:k]]
            mine = [r for r in got if r["user_id"] == user]
            assert [r["item_id"] for r in mine] == want and [r["rank"] for r in mine] == [*range(1, len(want) + 1)]


def test_one_block_of_items_is_ranked_in_its_cell(spark, crowd, vectors):
    """A table of items that a task can hold is one block, and its lists need no further shuffle."""
    found = rk.evaluation_cases(crowd, vectors)
    profiles = rk.user_profiles(found.history, vectors)
    whole, blocks = mt.recommend_nearest(profiles, vectors, 7), mt.recommend_nearest(profiles, vectors, 7, block_bytes=5000)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan
    assert "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[0]
    assert whole.dtypes == blocks.dtypes and sorted(whole.collect()) == sorted(blocks.collect())
    wide = spark.range(600_000).select(F.col("id").alias("item_id"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding"))
    assert "Window" not in mt.recommend_nearest(profiles, wide, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in mt.recommend_nearest(profiles, wide.withColumn("embedding", F.col("embedding").cast("array<double>")), 7)._jdf.queryExecution().executedPlan().toString()


def test_profiles_are_made_in_as_many_tasks_as_there_are(spark, crowd, vectors):
    """Ids are few bytes, so adaptive execution would make all profiles in a task or two."""
    found = rk.evaluation_cases(crowd, vectors)
    plan = rk.user_profiles(found.history, vectors)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
