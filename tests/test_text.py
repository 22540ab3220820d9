"""Golden values of the product-name functions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trolley.functions import similarity as sim
from trolley.functions import text as tx


def one(spark, build, *values):
    cols = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{c} string" for c in cols)
    df = spark.createDataFrame([values], schema)
    return df.select(build(*[F.col(c) for c in cols]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name,expected",
    [
        ("Organic Whole Milk 64 oz", "whole milk"),
        ("Best Water 12 x 8 Pure", "water"),
        ("Tea 1.5 lb  Bag", "tea bag"),
        ("Purely Great Greatness", "purely greatness"),
        ("Café Crème 10 ml", "café crème"),
        (None, ""),
    ],
)
def test_clean_product_name(spark, name, expected):
    assert one(spark, tx.clean_product_name, name) == expected


@pytest.mark.parametrize(
    "name,expected",
    [("Organic Milk", ""), ("Dove Soap", "dove"), ("A1 Sauce", ""), ("", ""), (None, "")],
)
def test_extract_brand(spark, name, expected):
    assert one(spark, tx.extract_brand, name) == expected


def test_category_keywords_hit_inside_words(spark):
    got = one(spark, tx.extract_category_keywords, "Dove Shampoo")
    assert got == ["meat", "ham", "personal_care", "shampoo"]
    assert one(spark, tx.extract_category_keywords, "Rice") == ["frozen", "ice", "pantry", "rice"]


@pytest.mark.parametrize(
    "name,terms,key",
    [
        ("Organic Whole Milk 64 oz", ["milk", "whole"], "milk_whole_organic whole milk 64 oz"),
        ("Hot Chocolate Milk Free", ["free", "milk", "chocolate"], "free_milk_hot chocolate milk free"),
        ("12 oz", ["12 oz"], "12 oz_12 oz"),
        ("Tea", ["tea"], "tea_tea"),
    ],
)
def test_key_terms_and_sort_key(spark, name, terms, key):
    assert one(spark, tx.extract_key_terms, name) == terms
    got = one(spark, lambda c: tx.smart_sort_key(c, tx.extract_key_terms(c)), name)
    assert got == key


def test_comparison_removes_plain_substrings(spark):
    assert one(spark, tx.clean_for_comparison, "Naturally Good Tea 12 ct") == "ly good tea"


@pytest.mark.parametrize(
    "text,expected", [("ice cream", "Ice Cream"), ("o'neil 3d", "O'Neil 3D"), ("", "")]
)
def test_title_case(spark, text, expected):
    assert one(spark, tx.title_case, text) == expected == text.title()


@pytest.mark.parametrize(
    "a,b,score", [("cold rod", "hot rod", 33), ("a b", "b a", 100), ("", "", 0), ("x", "", 0)]
)
def test_jaccard_words(spark, a, b, score):
    assert one(spark, lambda x, y: sim.similarity(x, y), a, b) == score


@pytest.mark.parametrize(
    "a,b,score", [("cold rod", "old rod", 93), ("kitten", "sitting", 62), ("", "", 100), ("a", "", 0)]
)
def test_indel(spark, a, b, score):
    assert one(spark, lambda x, y: sim.similarity(x, y, sim.INDEL), a, b) == score


@pytest.mark.parametrize(
    "first,second,ok",
    [
        (("produce", "Kale"), ("meat seafood", "Beef"), False),
        (("produce", "Kale"), ("produce", "Kale"), True),
        (("pantry", "Green Tea"), ("pantry", "Black Beans"), False),
        (("pantry", "Black Beans"), ("pantry", "Green Tea"), True),
        (("pets", "Dog Food"), ("babies", "Baby Food"), False),
    ],
)
def test_compatibility_is_one_directional(spark, first, second, ok):
    assert one(spark, sim.compatible, *first, *second) is ok


def test_shared_words(spark):
    got = one(spark, sim.shared_meaningful_words, "Organic Green Tea Bags", "organic tea bags green")
    assert got == 2


def test_subsequences_in_lanes_equal_those_one_by_one():
    draw = random.Random(5)
    sizes = [0, 1, 5, 30, 63, 64, 65, 130, 511, 512, 513, 700]

    def text():
        return "".join(draw.choice("abcde \x00\u00e9\u6f22\U0001f600") for _ in range(draw.choice(sizes)))

    left, right = ([text() for _ in range(400)] for _ in range(2))
    common, total = sim._subsequence_lengths(pd.Series(left), pd.Series(right))
    assert common.tolist() == [sim._common_subsequence(a, b) for a, b in zip(left, right)]
    assert total.tolist() == [len(a) + len(b) for a, b in zip(left, right)]
    none, _ = sim._subsequence_lengths(pd.Series([], dtype=str), pd.Series([], dtype=str))
    assert len(none) == 0
