"""The parallel family assignment against the sequential rule it must equal."""

import random

import pytest
from pyspark.sql import functions as F

from trolley.functions.similarity import JACCARD_WORDS, METRICS
from trolley.operators.families import (
    _joined_pairs,
    assign_families,
    candidate_lists,
    candidate_pairs,
    fuzzy_families,
    sort_products,
)


def sequential(n, passing, min_size, max_size, window):
    """Plain restatement of the rule, one product after the other."""
    used, found = set(), []
    for i in range(n):
        if i in used:
            continue
        used.add(i)
        family = [i]
        for j in range(i + 1, min(i + window, n - 1) + 1):
            if j in used or len(family) >= max_size:
                break
            if (i, j) in passing:
                used.add(j)
                family.append(j)
        if len(family) >= min_size:
            found.append(family)
    return found


def assigned(spark, n, passing, **kwargs):
    placed = spark.range(n).withColumnRenamed("id", "pos")
    pairs = spark.createDataFrame(list(passing) or [(0, 0)], "i bigint, j bigint").where("i < j")
    rows = assign_families(placed, pairs, **kwargs).orderBy("family_id", "member_no").collect()
    out = {}
    for r in rows:
        out.setdefault(r.family_id, []).append(r.pos)
    return [out[k] for k in sorted(out)], sorted(out)


@pytest.mark.parametrize(
    "seed,n,density,max_size,window,block,fanout",
    [
        (1, 60, 0.3, 4, 5, 6, 3),
        (2, 80, 0.7, 3, 7, 8, 2),
        (3, 70, 0.1, 15, 10, 11, 4),
        (4, 90, 1.0, 15, 20, 21, 2),  # one run of equal names through every block
        (5, 50, 0.5, 2, 3, 100, 10),
        (6, 64, 0.4, 6, 4, 5, 2),
        (7, 40, 0.0, 5, 4, 5, 2),
    ],
)
def test_equals_sequential(spark, seed, n, density, max_size, window, block, fanout):
    rng = random.Random(seed)
    passing = {
        (i, j)
        for i in range(n)
        for j in range(i + 1, min(i + window, n - 1) + 1)
        if rng.random() < density
    }
    got, ids = assigned(
        spark, n, passing, min_size=2, max_size=max_size, window=window,
        block_rows=block, fanout=fanout,
    )
    expected = sequential(n, passing, 2, max_size, window)
    assert got == expected
    assert ids == list(range(len(expected)))


def test_scan_stops_at_first_used(spark):
    # 1 would match 3 but stops at 2, which 0 has claimed
    got, _ = assigned(spark, 4, {(0, 2), (1, 3)}, min_size=2, max_size=15)
    assert got == [[0, 2]]


PRODUCTS = [
    (1, "Green Tea", "beverages", "tea"),
    (2, "Green Tea 12 ct", "beverages", "tea"),
    (3, "Organic Green Tea", "beverages", "tea"),
    (4, "Red Apple", "produce", "fresh fruits"),
    (5, "Red Apple", "meat seafood", "packaged"),
    (6, "Blue Plate", "household", "dishes"),
]


def test_named_families(spark):
    products = spark.createDataFrame(
        PRODUCTS, "product_id bigint, product_name string, department string, aisle string"
    )
    found = fuzzy_families(products)
    families = {r.family_name: r for r in found.families.collect()}
    assert list(families) == ["Tea Green Family"]
    tea = families["Tea Green Family"]
    assert (tea.size, tea.avg_similarity, tea.departments) == (3, 100.0, ["beverages"])
    members = [r.product_id for r in found.members.orderBy("member_no").collect()]
    assert sorted(members) == [1, 2, 3]


def test_pairs_plan_has_no_nested_loop(spark):
    products = spark.createDataFrame(
        PRODUCTS, "product_id bigint, product_name string, department string, aisle string"
    )
    pairs = candidate_pairs(sort_products(products))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs.where(F.col("i") >= F.col("j")).count() == 0


@pytest.mark.parametrize("name", ["jaccard_words", "indel"])
def test_size_bound_never_hides_a_pair(spark, name):
    metric = METRICS[name]
    rng = random.Random(8)
    texts = [" ".join(rng.choice("tea milk oat bar big x".split()) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = metric.prepare(F.col("a")), metric.prepare(F.col("b"))
    rows = pairs.select(metric.score(a, b).alias("score"), metric.at_most(a, b).alias("bound")).collect()
    assert all(r.score <= r.bound for r in rows)
    assert sum(r.bound >= 80 for r in rows) < len(rows) / 2


@pytest.mark.parametrize("threshold,window,tile_rows", [(80, 100, 2000), (50, 7, 10), (0, 3, 3), (34, 120, 1)])
def test_tiles_equal_the_band_join(spark, threshold, window, tile_rows):
    rng = random.Random(threshold)
    departments = ["meat seafood", "produce", "dairy eggs", "household", "other", None]
    rows = [
        (i, rng.choice([None, *[rng.sample("abcdefg", rng.randint(0, 5))] * 9]), rng.choice(departments), rng.randint(0, 3), rng.randint(0, 3))
        for i in range(260)
    ]
    placed = spark.createDataFrame(rows, "pos bigint, cmp array<string>, department string, bits1 int, bits2 int")
    joined = _joined_pairs(placed, JACCARD_WORDS, threshold, window).collect()
    listed = candidate_lists(placed, JACCARD_WORDS, threshold, window, tile_rows).collect()
    got = [(r.i, j, s) for r in listed for j, s in zip(r.js, r.scores, strict=True)]
    assert len(joined) > 50 and sorted(got) == sorted(tuple(r) for r in joined)
    assert all(r.js == sorted(r.js) for r in listed) and len({r.i for r in listed}) == len(listed)
    assert sorted(tuple(r) for r in candidate_pairs(placed, JACCARD_WORDS, threshold, window).collect()) == sorted(got)


def test_many_words_are_compared_in_parts(spark):
    # more words shared by two rows than a table of words holds
    one, two = [f"w{k}" for k in range(5000)], [f"w{k}" for k in range(1000, 6000)]
    rows = [(0, one, "x", 0, 0), (1, two, "x", 0, 0), (2, one, "x", 0, 0), (3, two, "x", 0, 0)]
    placed = spark.createDataFrame(rows, "pos bigint, cmp array<string>, department string, bits1 int, bits2 int")
    got = {(r.i, r.j): r.score for r in candidate_pairs(placed, threshold=0).collect()}
    assert got == {(0, 1): 66, (0, 2): 100, (0, 3): 66, (1, 2): 66, (1, 3): 100, (2, 3): 66}


def test_no_pair_of_products_is_a_row(spark):
    products = spark.createDataFrame(
        PRODUCTS, "product_id bigint, product_name string, department string, aisle string"
    )
    listed = candidate_lists(sort_products(products.coalesce(1)))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    # the only join adds the offsets of the sorted partitions
    assert plan.count("Join") <= 1 and "Join [bucket" not in plan
