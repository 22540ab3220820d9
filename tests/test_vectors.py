"""TF-IDF, SVD, composites and clustering against plain numpy."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.functions import vectors as vx
from trolley.operators import cluster as cl
from trolley.operators import composites as comp
from trolley.operators import linalg, neighbours, tfidf

DOCS = [
    (1, "red apple juice the red"), (2, "green apple"), (3, "red apple pie"),
    (4, "the juice"), (5, "apple 3d juice 3d"), (6, ""), (7, "red café juice apple"),
]


def reference_tfidf(docs, min_df, max_df, max_terms):
    stop = set(tfidf.STOP_WORDS)
    counts = {}
    for key, text in docs:
        words = [w for w in re.findall(r"\b[a-zA-Z][a-zA-Z0-9]*\b", text.lower()) if w not in stop]
        counts[key] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df, total = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        total.update(c)
    n = len(docs)
    terms = [t for t in df if min_df <= df[t] <= max_df * n]
    terms = sorted(sorted(terms, key=lambda t: (-total[t], t))[:max_terms])
    out = {}
    for key, c in counts.items():
        row = {
            i: c[t] * (math.log((1 + n) / (1 + df[t])) + 1) for i, t in enumerate(terms) if t in c
        }
        length = math.sqrt(sum(v * v for v in row.values()))
        out.update({(key, i): v / length for i, v in row.items()})
    return terms, out


@pytest.mark.parametrize("max_terms", [3, 5000])
def test_tfidf(spark, max_terms):
    docs = spark.createDataFrame(DOCS, "id bigint, text string")
    got = tfidf.tfidf(docs, "id", "text", max_terms=max_terms)
    terms, weights = reference_tfidf(DOCS, 2, 0.8, max_terms)
    assert [r.term for r in got.vocabulary.orderBy("idx").collect()] == terms
    rows = {(r.id, r.idx): r.weight for r in got.weights.collect()}
    assert rows.keys() == weights.keys()
    assert all(abs(rows[k] - weights[k]) < 1e-12 for k in rows)


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 2
    df = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)],
        "item_id bigint, embedding array<double>",
    )
    return x, df.repartition(3).persist()


def test_svd_matches_numpy(spark, items):
    x, df = items
    model = linalg.truncated_svd(df, 4)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.sigma, s[:4])
    assert np.allclose(model.u.T @ model.u, np.eye(4))
    assert np.allclose(np.abs(model.u), np.abs(vt[:4].T))
    assert np.allclose(model.explained, s[:4] ** 2 / (s**2).sum())
    got = linalg.project(df, model, scaled=True).orderBy("item_id").collect()
    want = centred @ model.u / model.sigma
    assert np.allclose([r.reduced for r in got], want)
    report = linalg.singular_report(model, spark).orderBy("component").collect()
    assert report[-1].cumulative_retained == pytest.approx(1.0)


def test_randomised_svd_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 60)) @ np.diag(0.7 ** np.arange(60)) @ rng.normal(size=(60, 60)) + 3
    df = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "item_id bigint, embedding array<double>"
    ).repartition(3)
    model = linalg.randomised_svd(df, 5)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.sigma, s[:5], rtol=1e-6)
    assert np.allclose(np.abs(model.u), np.abs(vt[:5].T), atol=1e-4)
    assert np.allclose(model.explained, s[:5] ** 2 / (s**2).sum(), rtol=1e-6)
    got = linalg.project_wide(df, model, scaled=True).orderBy("item_id").collect()
    assert np.allclose([r.reduced for r in got], centred @ model.u / model.sigma)
    with pytest.raises(ValueError, match="over"):
        linalg.randomised_svd(df, 5, basis_bytes=100)


def test_composites(spark, items):
    x, df = items
    members = spark.createDataFrame(
        [(0, 0, 3, "a"), (0, 1, 4, "b"), (0, 2, 999, "no vector"), (1, 0, 5, "alone"), (1, 1, 998, "x")],
        "family_id bigint, member_no int, product_id bigint, product_name string",
    )
    families = spark.createDataFrame(
        [(0, "A", 90.0), (1, "B", 80.0)], "family_id bigint, family_name string, avg_similarity double"
    )
    model = linalg.truncated_svd(df, 3)
    placed = comp.family_vectors(members, df)
    rows = comp.composites(families, placed, model).collect()
    assert [(r.family_id, r.size) for r in rows] == [(0, 2)]
    assert np.allclose(rows[0].composite_original, x[[3, 4]].mean(axis=0))
    shifted = comp.family_vectors(
        members, df, spark.createDataFrame([(3, 10), (4, 11)], "product_id bigint, item_id bigint")
    )
    assert sorted(r.item_id for r in shifted.collect()) == [10, 11]


def test_separation_verdict(spark):
    intra = spark.createDataFrame([(1.0,), (3.0,)], "distance double")
    inter = spark.createDataFrame([(2.6,)], "distance double")
    row = comp.separation(intra, inter).first()
    assert (row.separation_ratio, row.verdict) == (1.3, "moderate")


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    row = df.select(
        vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.l2_normalise(F.col("a")).alias("n"),
        vx.euclidean(F.col("a"), F.col("b")).alias("d"),
    ).first()
    assert (row.c, row.n, row.d) == (0.0, [0.0, 0.0], math.sqrt(5))


def test_clusters(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, size=(30, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame(
        [(i, [float(v) for v in p], i // 30, "even" if i % 2 == 0 else "odd") for i, p in enumerate(points)],
        "item_id bigint, embedding array<double>, label int, kind string",
    )
    model = cl.fit_kmeans(df, k=3, restarts=3)
    found = cl.assign_clusters(df, model)
    assert sorted(r.size for r in cl.cluster_centres(found).collect()) == [30, 30, 30]
    assert cl.silhouette(df, "label") > 0.9
    row = cl.calinski_harabasz(df, "label").first()
    centres = np.array([points[i * 30 : i * 30 + 30].mean(axis=0) for i in range(3)])
    within = sum(((points[i * 30 : i * 30 + 30] - centres[i]) ** 2).sum() for i in range(3))
    between = 30 * ((centres - points.mean(axis=0)) ** 2).sum()
    assert row.calinski_harabasz == pytest.approx(between * 87 / (within * 2))
    coherence = cl.cluster_coherence(df, "label", "kind").collect()
    assert len(coherence) == 3 and all(8 / 15 <= r.coherence <= 1 for r in coherence)


def test_sample_neighbours_exclude_self_and_break_ties_by_id(spark):
    rows = [(1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0), (4, 0, 0.6), (4, 1, 0.8)]
    vectors = spark.createDataFrame(rows, "id bigint, idx int, weight double")
    sample = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)], "id bigint, sample_no int")
    got = neighbours.sample_neighbours(vectors, sample, 2).collect()
    near = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        near.setdefault(r.id, []).append(r.neighbour_id)
    assert near == {1: [2, 4], 2: [1, 4], 3: [4, 1], 4: [3, 1], 5: [1, 2]}


def test_all_restarts_move_in_one_scan(spark):
    """As good as the best of separate fits, with a job per round and not per restart."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.8, (60, 3)) for c in rng.normal(0, 3, (6, 3))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "item_id bigint, embedding array<double>")
    df = df.unionByName(spark.createDataFrame([(-1, None)], df.schema))
    found = cl.fit_kmeans(df, k=6, restarts=20)
    single = df.where("item_id >= 0").withColumn("x", array_to_vector("embedding"))
    best = min(KMeans(k=6, featuresCol="x", seed=s, maxIter=300).fit(single).summary.trainingCost for s in range(5))
    apart = ((points[:, None] - np.array(found.centres)) ** 2).sum(axis=2).min(axis=1).sum()
    assert found.cost == pytest.approx(apart, rel=1e-3) and found.cost <= best * 1.001
    assert cl.fit_kmeans(df, k=6, restarts=20) == found
    few = cl.fit_kmeans(df.where("item_id < 2"), k=5, restarts=2)
    assert len(few.centres) == 2 and few.cost == pytest.approx(0)


def test_a_grid_records_what_fails(spark):
    df = spark.createDataFrame([(i, [float(i // 10), 1.0], i // 10) for i in range(30)], "item_id bigint, embedding array<double>, g int")

    def broken(items):
        raise RuntimeError("no such method")

    grid = [
        ("group", "3", lambda v: v.withColumn("cluster", F.col("g"))),
        ("group", "noise", lambda v: v.withColumn("cluster", F.when(F.col("g") == 0, 0).otherwise(cl.NOISE))),
        ("other", "x", broken),
        ("other", "column", lambda v: v.withColumn("cluster", F.col("missing"))),
    ]
    rows = {(r.method, r.params): r for r in cl.run_grid(df, grid).collect()}
    assert rows["group", "3"].succeeded and rows["group", "3"].silhouette == pytest.approx(1)
    assert rows["group", "noise"].failure == "ValueError: 1 clusters, two are needed"
    assert rows["other", "x"].failure == "RuntimeError: no such method"
    assert not rows["other", "column"].succeeded and "missing" in rows["other", "column"].failure
    summary = cl.run_summary(cl.run_grid(df, grid)).first()
    assert (summary.total_methods_tested, summary.success_rate) == (2, 0.25)
