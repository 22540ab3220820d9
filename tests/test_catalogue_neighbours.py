"""Neighbours of a whole sparse catalogue against all scalar products."""

import math
import random

import pytest

from trolley.operators import catalogue_neighbours as cn


def unit(row):
    norm = math.sqrt(sum(w * w for w in row.values()))
    return {i: w / norm for i, w in row.items()}


def brute(rows, k):
    out = []
    for a, va in rows.items():
        scores = []
        for b, vb in rows.items():
            score = round(sum(w * vb.get(i, 0.0) for i, w in sorted(va.items())), 9)
            if a != b and score > 0:
                scores.append((-score, b))
        out += [(a, r, b, round(-s, 6)) for r, (s, b) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def catalogue(seed, n, width, hot):
    rng = random.Random(seed)
    rows = {}
    for i in range(n):
        # common terms are light, rare ones heavy, as in weighted texts
        row = {t: 1 + math.log(1 + t) * rng.choice([1, 1, 2]) for t in (int(width * rng.random() ** 2) for _ in range(rng.randint(1, 6)))}
        rows[i * 3] = unit(row)
    for i in range(hot):
        rows[10_000 + i] = dict(rows[0])
    rows[20_000] = {width + 5: 1.0}
    return rows


@pytest.mark.parametrize(("k", "cell"), [(1, 2_000), (5, 7), (40, 2_000)])
def test_neighbours_are_exact(spark, monkeypatch, k, cell):
    monkeypatch.setattr(cn, "CELL_ROWS", cell)
    monkeypatch.setattr(cn, "PROBED_ROWS", 6)
    rows = catalogue(k, 150, 60, 60)
    data = [(i, t, w) for i, row in rows.items() for t, w in row.items()]
    df = spark.createDataFrame(data, "id bigint, idx int, weight double").repartition(3)
    got = cn.catalogue_neighbours(df, k).collect()
    assert sorted((r.id, r["rank"], r.neighbour_id, round(r.score, 6)) for r in got) == brute(rows, k)


def test_few_candidates_meet(spark):
    """Rows of distinct rare terms meet only their own kind, whatever common terms they hold."""
    rows = {i: unit({0: 0.1, 1 + i // 12: 1.0, 1000 + i: 0.2}) for i in range(600)}
    df = spark.createDataFrame([(i, t, w) for i, row in rows.items() for t, w in row.items()], "id bigint, idx int, weight double")
    _, classes = cn._classes(df)
    terms = cn._ordered_terms(classes)
    pairs = cn._candidates(terms, cn._least_scores(terms, classes, 5))
    assert pairs.count() == 600 * 11


def test_empty_catalogue(spark):
    df = spark.createDataFrame([], "id bigint, idx int, weight double")
    assert cn.catalogue_neighbours(df, 3).collect() == []
