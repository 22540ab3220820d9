"""Queries over item vectors: reduction, composites, clustering scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trolley.functions.vectors import cosine, l2_normalise
from trolley.operators import cluster as cl
from trolley.operators import composites as comp
from trolley.operators import families as fam
from trolley.operators import linalg
from trolley.operators.split import stratified_sample
from trolley.plans.jobs import reduce_products
from trolley.registry.base import query, rounded
from trolley.registry.catalogue import _families_sql
from trolley.registry.inputs import VECTORS_SQL, enriched, table, vectors
from trolley.sources import tables as src
from trolley.storage import new_path, written

WITH = f"WITH {VECTORS_SQL}"
# one row per vector element; d counts from 0
_LONG_SQL = f"""{WITH}, long AS (
  SELECT item_id, label, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x FROM vectors),
means AS (SELECT d, avg(x) AS m, count(*) AS n FROM long GROUP BY d)
"""


def _spread(df: DataFrame, col: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("d", "x")).select(
        *keys, F.col("d").cast("bigint").alias("d"), rounded("x").alias("x")
    )


@query(
    "item_vectors",
    """SELECT vec_id - 2 AS item_id, generate_subscripts(embedding, 1) - 1 AS d,
      round(unnest(embedding::DOUBLE[]), 6) AS x FROM embeddings WHERE vec_id >= 2""",
)
def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the two special rows dropped and ids re-based."""
    items = src.item_vectors(table(spark, sf, "embeddings"))
    return _spread(
        items.withColumn("embedding", F.col("embedding").cast("array<double>")),
        "embedding", "item_id",
    )


@query("column_means", f"{_LONG_SQL} SELECT d, round(m, 6) + 0 AS mean FROM means")
def column_means(spark: SparkSession, sf: str) -> DataFrame:
    mean = linalg.column_means(vectors(spark, sf))
    return spark.createDataFrame(
        [(d, float(m)) for d, m in enumerate(mean)], "d bigint, mean double"
    ).withColumn("mean", rounded("mean"))


@query(
    "centred_vectors",
    f"{_LONG_SQL} SELECT item_id, d, round(x - m, 6) + 0 AS x FROM long JOIN means USING (d)",
)
def centred_vectors(spark: SparkSession, sf: str) -> DataFrame:
    items = vectors(spark, sf)
    return _spread(linalg.centred(items, linalg.column_means(items)), "embedding", "item_id")


@query(
    "unit_vectors",
    f"""{_LONG_SQL} SELECT item_id, d,
      round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) + 0 AS x FROM long""",
)
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    unit = vectors(spark, sf).withColumn("embedding", l2_normalise(F.col("embedding")))
    return _spread(unit, "embedding", "item_id")


@query(
    "cosine_to_mean",
    f"""{_LONG_SQL} SELECT item_id,
      round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) + 0 AS similarity
    FROM long JOIN means USING (d) GROUP BY item_id""",
)
def cosine_to_mean(spark: SparkSession, sf: str) -> DataFrame:
    items = vectors(spark, sf)
    mean = F.array(*[F.lit(float(m)) for m in linalg.column_means(items)])
    return items.select(
        "item_id", rounded(cosine(F.col("embedding"), mean)).alias("similarity")
    )


@query(
    "svd_energy",
    f"""{_LONG_SQL} SELECT round(sum((x - m) * (x - m)), 4) AS energy,
      round(1.0::DOUBLE, 6) AS explained FROM long JOIN means USING (d)""",
)
def svd_energy(spark: SparkSession, sf: str) -> DataFrame:
    """At full rank the squared singular values add up to the centred sum of squares."""
    items = vectors(spark, sf)
    model = linalg.truncated_svd(items, src.vector_width(items))
    return linalg.singular_report(model, spark).agg(
        F.round(F.sum(F.col("singular_value") ** 2), 4).alias("energy"),
        F.round(F.sum("explained_ratio"), 6).alias("explained"),
    )


@query(
    "svd_row_lengths",
    f"""{_LONG_SQL} SELECT item_id, round(sqrt(sum((x - m) * (x - m))), 6) AS length
    FROM long JOIN means USING (d) GROUP BY item_id""",
)
def svd_row_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """A full-rank reduction is a rotation, so it keeps every centred row's length."""
    items = vectors(spark, sf)
    model = linalg.truncated_svd(items, src.vector_width(items))
    length = F.sqrt(F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x))
    return linalg.project(items, model).select("item_id", rounded(length).alias("length"))


@query("svd_singular_values")
def svd_singular_values(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty components with their explained and cumulative retained variance."""
    return linalg.singular_report(linalg.truncated_svd(vectors(spark, sf), 50), spark)


@query("reduced_vectors")
def reduced_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-dimensional coordinates of the centred vectors."""
    items = vectors(spark, sf)
    return linalg.project(items, linalg.truncated_svd(items, 10)).select("item_id", "reduced")


@query("mapped_vectors")
def mapped_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors mapped into the scaled reduced space (the rows of V)."""
    items = vectors(spark, sf)
    model = linalg.truncated_svd(items, 50)
    return linalg.project(items, model, scaled=True).select("item_id", "reduced")


# the scatter matrix, its square and cube, and every row's quadratic forms with them, each
# divided by the same power of the trace
_MOMENTS_SQL = f"""{_LONG_SQL}, centred AS (
  SELECT item_id, d, x - m AS x FROM long JOIN means USING (d)),
scatter AS (
  SELECT a.d AS i, b.d AS j, sum(a.x * b.x) AS c FROM centred a JOIN centred b USING (item_id)
  GROUP BY a.d, b.d),
total AS (SELECT sum(c) AS t FROM scatter WHERE i = j),
c1 AS (SELECT i, j, c / t AS c FROM scatter, total),
c2 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c1 a JOIN c1 b ON a.j = b.i GROUP BY a.i, b.j),
c3 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c2 a JOIN c1 b ON a.j = b.i GROUP BY a.i, b.j),
powers AS (SELECT 1 AS p, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3)
"""
_ROW_MOMENTS_SQL = f"""{_MOMENTS_SQL}, imaged AS (
  SELECT item_id, p, j AS d, sum(x * c) AS y FROM centred JOIN powers ON d = i
  GROUP BY item_id, p, j)
SELECT item_id, p, round(sum(x * y) * (SELECT count(DISTINCT d) FROM means) ** p, 6) AS moment
FROM imaged JOIN centred USING (item_id, d) GROUP BY item_id, p"""
_POWERS = (1, 2, 3)


def _relative_squares(model: linalg.SvdModel | linalg.WideSvd) -> Column:
    """Squared singular values as shares of their sum, as an array literal."""
    squares = model.sigma**2
    return F.array(*[F.lit(float(v)) for v in squares / squares.sum()])


def _row_moments(placed: DataFrame, model: linalg.SvdModel | linalg.WideSvd, extra: int = 0) -> DataFrame:
    """Per row and p: squared coordinates weighted by the p-th power of their squared value."""
    width = len(model.sigma)
    share = _relative_squares(model)
    total = float((model.sigma**2).sum())
    return placed.select(
        "item_id", "reduced", F.explode(F.array(*[F.lit(p) for p in _POWERS])).alias("p")
    ).select(
        "item_id",
        "p",
        F.round(
            F.aggregate(
                F.zip_with("reduced", share, lambda y, w: y * y * F.pow(w, F.col("p") + extra)),
                F.lit(0.0),
                lambda a, v: a + v,
            )
            * F.pow(F.lit(float(width)), F.col("p"))
            * total**extra,
            6,
        ).alias("moment"),
    )


@query(
    "svd_moments",
    f"""{_MOMENTS_SQL} SELECT p, round(sum(c) * (SELECT count(DISTINCT d) FROM means) ** (p - 1), 9)
    AS moment FROM powers WHERE i = j GROUP BY p""",
)
def svd_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Power sums of the squared singular values are traces of powers of the scatter matrix."""
    items = vectors(spark, sf)
    width = src.vector_width(items)
    report = linalg.singular_report(linalg.truncated_svd(items, width), spark)
    # the retained share grows by the share of each component
    by_component = Window.orderBy("component")
    kept = F.col("cumulative_retained")
    shares = report.select((kept - F.lag(kept, 1, 0.0).over(by_component)).alias("s"))
    return shares.select("s", F.explode(F.array(*[F.lit(p) for p in _POWERS])).alias("p")).groupBy("p").agg(
        F.round(F.sum(F.pow("s", "p")) * F.pow(F.lit(float(width)), F.col("p") - 1), 9).alias("moment")
    )


@query("reduced_moments", _ROW_MOMENTS_SQL)
def reduced_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates along the components, told from any other rotation by their weights."""
    items = vectors(spark, sf)
    model = linalg.truncated_svd(items, src.vector_width(items))
    return _row_moments(linalg.project(items, model), model)


@query("mapped_moments", _ROW_MOMENTS_SQL)
def mapped_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The same from rows of V, whose coordinates are divided by the singular values."""
    items = vectors(spark, sf)
    model = linalg.truncated_svd(items, src.vector_width(items))
    return _row_moments(linalg.project(items, model, scaled=True), model, extra=1)


@query("wide_moments", _ROW_MOMENTS_SQL)
def wide_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The decomposition for wide vectors, with a basis that spans them all."""
    items = vectors(spark, sf).select("item_id", "embedding")
    model = linalg.randomised_svd(items, src.vector_width(items))
    return _row_moments(linalg.project_wide(items, model), model)


_COMPOSITE_SQL = f"""{_families_sql(80)},
{VECTORS_SQL.strip()},
member_vectors AS (SELECT family_id, member_no, product_id, v FROM members
  JOIN vectors ON item_id = product_id),
sized AS (SELECT family_id, count(*) AS size FROM member_vectors GROUP BY family_id
  HAVING count(*) >= 2),
centres AS (
  SELECT family_id, d, avg(x) AS x FROM (
    SELECT family_id, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x
    FROM member_vectors JOIN sized USING (family_id)) GROUP BY family_id, d)
"""


def _composites(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found = fam.fuzzy_families(enriched(spark, sf))
    placed = written(comp.family_vectors(found.members, vectors(spark, sf)), "family-vectors")
    return placed, written(comp.composites(found.families, placed), "composites")


@query(
    "composite_vectors",
    f"{_COMPOSITE_SQL} SELECT family_id, d, round(x, 6) + 0 AS x FROM centres",
)
def composite_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(_composites(spark, sf)[1], "composite_original", "family_id")


@query(
    "composite_sizes",
    f"""{_COMPOSITE_SQL} SELECT count(*) AS composites, round(avg(size), 6) AS avg_size,
      max(size) AS max_size, min(size) AS min_size FROM sized""",
)
def composite_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return comp.composite_sizes(_composites(spark, sf)[1]).withColumn(
        "avg_size", rounded("avg_size")
    )


@query(
    "largest_composites",
    f"""{_COMPOSITE_SQL} SELECT s.family_id, family_name, s.size,
      round(avg_similarity, 6) AS avg_similarity FROM sized s JOIN summary USING (family_id)
    ORDER BY s.size DESC, s.family_id LIMIT 10""",
)
def largest_composites(spark: SparkSession, sf: str) -> DataFrame:
    return comp.largest_composites(_composites(spark, sf)[1]).select(
        "family_id", "family_name", "size", rounded("avg_similarity").alias("avg_similarity")
    )


@query(
    "family_separation",
    f"""{_COMPOSITE_SQL},
    member_long AS (
      SELECT family_id, member_no, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x
      FROM member_vectors JOIN sized USING (family_id)),
    intra AS (
      SELECT sqrt(sum((a.x - c.x) * (a.x - c.x))) AS distance
      FROM member_long a JOIN centres c USING (family_id, d) GROUP BY family_id, member_no),
    few AS (SELECT family_id FROM sized ORDER BY family_id LIMIT 50),
    few_centres AS (SELECT centres.* FROM centres JOIN few USING (family_id)),
    inter AS (
      SELECT sqrt(sum((a.x - b.x) * (a.x - b.x))) AS distance
      FROM few_centres a JOIN few_centres b ON a.d = b.d AND a.family_id < b.family_id
      GROUP BY a.family_id, b.family_id),
    ratio AS (
      SELECT (SELECT avg(distance) FROM intra) AS a, (SELECT avg(distance) FROM inter) AS b)
    SELECT round(a, 6) AS avg_intra_distance, round(b, 6) AS avg_inter_distance,
      round(b / a, 6) AS separation_ratio,
      CASE WHEN b / a > 1.5 THEN 'good' WHEN b / a > 1.2 THEN 'moderate' ELSE 'poor' END AS verdict
    FROM ratio""",
)
def family_separation(spark: SparkSession, sf: str) -> DataFrame:
    """Family quality in the original space."""
    placed, composite = _composites(spark, sf)
    members = placed.join(composite.select("family_id", "composite_original"), "family_id")
    report = comp.separation(
        comp.intra_distances(members, "embedding", "composite_original"),
        comp.inter_distances(composite, "composite_original"),
    )
    return report.withColumns({c: rounded(c) for c in report.columns if c != "verdict"})


@query(
    "family_spread",
    f"""{_COMPOSITE_SQL} SELECT count(*) AS pairs, round(avg(sq), 6) AS mean_square_distance FROM (
      SELECT sum((a.x - b.x) * (a.x - b.x)) AS sq FROM centres a JOIN centres b
        ON a.d = b.d AND a.family_id < b.family_id
      WHERE a.family_id IN (SELECT family_id FROM sized)
        AND b.family_id IN (SELECT family_id FROM sized) GROUP BY a.family_id, b.family_id)""",
)
def family_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between all composites, beside the figure over the first fifty."""
    n = F.col("composites")
    return comp.mean_square_distance(_composites(spark, sf)[1], "composite_original").select(
        (n * (n - 1) / 2).cast("bigint").alias("pairs"),
        rounded("mean_square_distance").alias("mean_square_distance"),
    )


def _reduction(spark: SparkSession, sf: str, path: str | None = None):
    found = fam.fuzzy_families(enriched(spark, sf))
    return reduce_products(vectors(spark, sf), found.families, found.members, path=path)


@query("family_quality")
def family_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Family quality in the reduced space: the whole reduction job."""
    return _reduction(spark, sf).quality


@query("composite_reductions")
def composite_reductions(spark: SparkSession, sf: str) -> DataFrame:
    return _reduction(spark, sf).composites.select("family_id", "composite_reduced")


@query(
    "composite_mean_identity",
    f"""{_COMPOSITE_SQL} SELECT family_id, size, round(0.0::DOUBLE, 6) AS gap FROM sized""",
)
def composite_mean_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The map is affine: a reduced composite is the mean of its reduced members."""
    members = _reduction(spark, sf).members
    elements = members.select(
        "family_id",
        "member_no",
        F.posexplode(F.arrays_zip("component_reduced", "composite_reduced")).alias("k", "e"),
    )
    return (
        elements.groupBy("family_id", "k")
        .agg(
            F.avg("e.component_reduced").alias("mean"),
            F.first("e.composite_reduced").alias("mapped"),
            F.count("*").alias("size"),
        )
        .groupBy("family_id")
        .agg(
            F.max("size").alias("size"),
            rounded(F.max(F.abs(F.col("mean") - F.col("mapped")))).alias("gap"),
        )
    )


@query(
    "reduction_output",
    f"""{_COMPOSITE_SQL} SELECT 50::INTEGER AS r_components,
      (SELECT max(len(v)) FROM vectors)::INTEGER AS u_rows, 50::INTEGER AS u_columns,
      (SELECT count(*) FROM vectors) AS v_rows, (SELECT count(*) FROM sized) AS composites,
      (SELECT count(*) FROM vectors) AS stored_v, 50::BIGINT AS stored_values""",
)
def reduction_output(spark: SparkSession, sf: str) -> DataFrame:
    """The reduction job written to files and read back."""
    path = new_path(spark, "svd")
    _reduction(spark, sf, path)
    counts = {
        "composites": spark.read.parquet(f"{path}/composites").count(),
        "stored_v": spark.read.parquet(f"{path}/v").count(),
        "stored_values": spark.read.parquet(f"{path}/singular_values").count(),
    }
    info = spark.read.parquet(f"{path}/info").drop("explained_variance", "mean")
    return info.withColumns({k: F.lit(v).cast("bigint") for k, v in counts.items()})


# --- clustering, with the given labels and coarser ones made from them

_SILHOUETTE_SQL = """
pair_means AS (
  SELECT a.item_id, a.c, b.c AS other, count(*) AS n,
    sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS total
  FROM clustered a JOIN clustered b ON true GROUP BY a.item_id, a.c, b.c),
own AS (SELECT item_id, n, total / nullif(n - 1, 0) AS a FROM pair_means WHERE c = other),
nearest AS (SELECT item_id, min(total / n) AS b FROM pair_means WHERE c <> other GROUP BY item_id),
silhouettes AS (
  SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette
  FROM own JOIN nearest USING (item_id))
"""


def _clustered_sql(label: str) -> str:
    return f"""{WITH}, clustered AS (SELECT item_id, v, {label} AS c FROM vectors)"""


_CH_SQL = """
elements AS (
  SELECT item_id, c, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x FROM clustered),
centres AS (SELECT c, d, avg(x) AS m, count(*) AS n FROM elements GROUP BY c, d),
overall AS (SELECT d, avg(x) AS m FROM elements GROUP BY d),
spread_within AS (
  SELECT sum((x - m) * (x - m)) AS within FROM elements JOIN centres USING (c, d)),
spread_between AS (
  SELECT sum(n * (centres.m - overall.m) * (centres.m - overall.m)) AS between_
  FROM centres JOIN overall USING (d)),
sizes AS (SELECT count(*) AS n_rows, count(DISTINCT c) AS n_clusters FROM clustered),
ch AS (SELECT n_rows, n_clusters, within, between_,
  between_ * (n_rows - n_clusters) / (within * (n_clusters - 1)) AS score
  FROM sizes, spread_within, spread_between)
"""


@query(
    "silhouette",
    f"{_clustered_sql('label')}, {_SILHOUETTE_SQL} SELECT round(silhouette, 6) AS silhouette FROM silhouettes",
)
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    score = cl.silhouette(vectors(spark, sf), "label")
    return spark.createDataFrame([(score,)], "silhouette double").select(
        rounded("silhouette").alias("silhouette")
    )


@query(
    "calinski_harabasz",
    f"""{_clustered_sql('label')}, {_CH_SQL} SELECT n_rows, n_clusters, round(within, 6) AS within,
      round(between_, 6) AS between, round(score, 6) AS calinski_harabasz FROM ch""",
)
def calinski_harabasz(spark: SparkSession, sf: str) -> DataFrame:
    report = cl.calinski_harabasz(vectors(spark, sf), "label")
    return report.withColumns(
        {c: rounded(c) for c in ("within", "between", "calinski_harabasz")}
    )


def _clustering_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three clusterings of the given labels scored like the runs of a parameter grid."""
    items = vectors(spark, sf)
    out = None
    for groups in (10, 5, 2):
        named = items.withColumn("c", F.col("label") % groups)
        score = cl.silhouette(named, "c")
        row = cl.calinski_harabasz(named, "c").select(
            F.lit("labels").alias("method"),
            F.lit(f"k{groups}").alias("params"),
            F.lit(score).alias("silhouette"),
            "calinski_harabasz",
            F.lit(True).alias("succeeded"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def _runs_sql() -> str:
    parts = []
    for groups in (10, 5, 2):
        parts.append(
            f"""SELECT * FROM ({_clustered_sql(f'label % {groups}')}, {_SILHOUETTE_SQL}, {_CH_SQL}
            SELECT 'labels' AS method, 'k{groups}' AS params, silhouette,
              score AS calinski_harabasz FROM silhouettes, ch)"""
        )
    return " UNION ALL ".join(parts)


@query(
    "best_clustering_run",
    f"""SELECT method, params, round(silhouette, 6) AS silhouette,
      round(calinski_harabasz, 6) AS calinski_harabasz,
      round(silhouette + calinski_harabasz / 10000, 6) AS combined_score
    FROM ({_runs_sql()}) ORDER BY silhouette + calinski_harabasz / 10000 DESC LIMIT 1""",
)
def best_clustering_run(spark: SparkSession, sf: str) -> DataFrame:
    best = cl.best_run(_clustering_runs(spark, sf)).drop("succeeded")
    return best.withColumns(
        {c: rounded(c) for c in ("silhouette", "calinski_harabasz", "combined_score")}
    )


# clusterings by label groups and by the signs of leading components; one group fails
_GRID = [("labels", g) for g in (10, 5, 2, 1)] + [("signs", p) for p in (0, 1, 3)]


def _grid_clusters(method: str, size: int, component: str) -> str:
    if method == "labels":
        return f"label % {size}"
    bits = [f"CASE WHEN {component.format(i + 1)} > 0 THEN {1 << i} ELSE 0 END" for i in range(size)]
    return " + ".join(["0", *bits])


def _grid_run_sql(method: str, size: int) -> str:
    return f"""SELECT * FROM ({_clustered_sql(_grid_clusters(method, size, "v[{}]"))}, {_SILHOUETTE_SQL}, {_CH_SQL}
      SELECT '{method}' AS method, '{size}' AS params, n_clusters >= 2 AS succeeded,
        CASE WHEN n_clusters >= 2 THEN round(silhouette, 6) END AS silhouette,
        CASE WHEN n_clusters >= 2 THEN round(score, 6) END AS calinski_harabasz,
        CASE WHEN n_clusters < 2 THEN 'ValueError: ' || n_clusters || ' clusters, two are needed' END AS failure
      FROM silhouettes, ch)"""


_GRID_SQL = " UNION ALL ".join(_grid_run_sql(*run) for run in _GRID)


def _grid_runs(spark: SparkSession, sf: str) -> DataFrame:
    def by(method: str, size: int):
        named = _grid_clusters(method, size, "element_at(embedding, {})")
        return lambda items: items.withColumn("cluster", F.expr(named))

    return cl.run_grid(vectors(spark, sf), [(m, str(s), by(m, s)) for m, s in _GRID])


@query("clustering_grid", _GRID_SQL)
def clustering_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every run of a grid with its scores, or why it failed."""
    return _grid_runs(spark, sf).withColumns(
        {c: rounded(c) for c in ("silhouette", "calinski_harabasz")}
    )


@query(
    "grid_success_rate",
    f"""SELECT count(DISTINCT method) AS total_methods_tested, count(*) AS total_parameter_combinations,
      count(*) FILTER (succeeded) AS successful_combinations,
      round(count(*) FILTER (succeeded) / count(*)::DOUBLE, 6) AS success_rate FROM ({_GRID_SQL})""",
)
def grid_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The share of a grid's runs that gave a clustering."""
    return cl.run_summary(_grid_runs(spark, sf)).withColumn("success_rate", rounded("success_rate"))


@query(
    "clustering_success_rate",
    """SELECT count(DISTINCT l_returnflag) AS total_methods_tested,
      count(*) AS total_parameter_combinations,
      count(*) FILTER (n > 2500) AS successful_combinations,
      round(count(*) FILTER (n > 2500) / count(*)::DOUBLE, 6) AS success_rate
    FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def clustering_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The grid summary on (method, params, succeeded) rows derived from line items."""
    runs = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("params"))
        .agg((F.count("*") > 2500).alias("succeeded"))
    )
    return cl.run_summary(runs).withColumn("success_rate", rounded("success_rate"))


@query(
    "noise_ratio",
    f"""{WITH} SELECT round(avg((label = 0)::INTEGER), 6) AS noise_ratio FROM vectors""",
)
def noise_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Label 0 stands for the unassigned rows."""
    named = vectors(spark, sf).withColumn(
        "cluster", F.when(F.col("label") == 0, cl.NOISE).otherwise(F.col("label"))
    )
    return cl.noise_ratio(named).withColumn("noise_ratio", rounded("noise_ratio"))


@query(
    "stratified_sample",
    f"""{WITH}, shares AS (
      SELECT item_id, label, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total,
        row_number() OVER (PARTITION BY label
          ORDER BY md5(concat_ws('|', '42', item_id)), item_id) AS rn FROM vectors)
    SELECT item_id, label FROM shares WHERE rn <= ceil(n * 200 / total)""",
)
def stratified(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_sample(vectors(spark, sf), "label", "item_id", 200).select(
        "item_id", "label"
    )


_COHERENCE_SQL = f"""{WITH},
elements AS (
  SELECT item_id, label, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x FROM vectors),
centres AS (SELECT label, d, avg(x) AS m FROM elements GROUP BY label, d),
distances AS (
  SELECT item_id, label, sum((x - m) * (x - m)) AS dist FROM elements JOIN centres USING (label, d)
  GROUP BY item_id, label),
near AS (
  SELECT label, p_type AS department, row_number() OVER (
    PARTITION BY label ORDER BY dist, item_id) AS rn
  FROM distances JOIN part ON p_partkey = item_id),
counted AS (
  SELECT label, department, count(*) AS n FROM near WHERE rn <= 15 GROUP BY label, department),
best AS (
  SELECT *, sum(n) OVER (PARTITION BY label) AS inspected,
    row_number() OVER (PARTITION BY label ORDER BY n DESC, department) AS r FROM counted),
coherence AS (
  SELECT label AS cluster, (SELECT count(*) FROM vectors w WHERE w.label = best.label)
    AS cluster_size, department, n / inspected AS coherence FROM best WHERE r = 1)
"""


def _coherence(spark: SparkSession, sf: str) -> DataFrame:
    departments = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_type").alias("department")
    )
    items = vectors(spark, sf).join(departments, "item_id", "left")
    return cl.cluster_coherence(items, "label", "department")


@query(
    "cluster_coherence",
    f"""{_COHERENCE_SQL} SELECT cluster, cluster_size, department,
      round(coherence, 6) AS coherence FROM coherence""",
)
def cluster_coherence(spark: SparkSession, sf: str) -> DataFrame:
    return _coherence(spark, sf).withColumn("coherence", rounded("coherence"))


@query(
    "coherence_summary",
    f"""{_COHERENCE_SQL} SELECT count(*) AS total_clusters,
      round(avg(coherence), 6) AS average_coherence,
      count(DISTINCT department) AS category_coverage FROM coherence""",
)
def coherence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cl.coherence_summary(_coherence(spark, sf), "department").withColumn(
        "average_coherence", rounded("average_coherence")
    )


@query(
    "cluster_departments",
    f"""{_COHERENCE_SQL} SELECT department, count(*) AS clusters, sum(cluster_size)::BIGINT AS items,
      round(count(*) / (SELECT count(*) FROM coherence)::DOUBLE, 6) AS share
    FROM coherence GROUP BY department""",
)
def cluster_departments(spark: SparkSession, sf: str) -> DataFrame:
    """Departments by the clusters that they dominate."""
    return cl.category_representation(_coherence(spark, sf), "department").withColumn(
        "share", rounded("share")
    )


@query(
    "kmeans_facts",
    """SELECT count(*) AS n_rows, 5::BIGINT AS n_clusters, 0::BIGINT AS misplaced,
      0.0::DOUBLE AS largest_gap FROM embeddings""",
)
def kmeans_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for any converged k-means: nearest centres, centres that are means."""
    items = vectors(spark, sf)
    reduced = linalg.project(items, linalg.truncated_svd(items, 10))
    model = cl.fit_kmeans(reduced, "reduced")
    facts = cl.kmeans_facts(cl.assign_clusters(reduced, model, "reduced"), model, "reduced")
    return facts.withColumn("largest_gap", rounded("largest_gap", 3))


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty k-means restarts on the ten-dimensional reduction, and the cluster sizes."""
    items = vectors(spark, sf)
    reduced = linalg.project(items, linalg.truncated_svd(items, 10))
    model = cl.fit_kmeans(reduced, "reduced")
    return cl.cluster_centres(cl.assign_clusters(reduced, model, "reduced"), col="reduced")
