"""Queries over leave-out candidate ranking and list metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators import linalg
from trolley.operators import metrics as mt
from trolley.operators import ranking as rk
from trolley.operators.baskets import Baskets
from trolley.operators.vocab import distinct_items
from trolley.plans.jobs import compare_rankers
from trolley.registry.base import query, rounded
from trolley.registry.inputs import (
    BASKETS_SQL,
    VECTORS_SQL,
    basket_items,
    baskets,
    long_of,
    vectors,
)
from trolley.storage import outliving, passing

_USAGE_SQL = f"""WITH {BASKETS_SQL}, {VECTORS_SQL},
fit AS (
  SELECT user_id, basket_id,
    basket_pos < greatest(1, floor((n_baskets - 1) * 0.8::DOUBLE)) AS is_history
  FROM headers WHERE n_baskets - 1 >= 2),
usage AS (
  SELECT user_id, item_id, bool_or(is_history) AS in_history, bool_or(NOT is_history) AS in_test,
    count(*) FILTER (is_history) AS times
  FROM fit JOIN items USING (basket_id) WHERE item_id IN (SELECT item_id FROM vectors)
  GROUP BY user_id, item_id),
history AS (SELECT user_id, item_id, times FROM usage WHERE in_history),
history_sizes AS (SELECT user_id, count(*) AS history_size FROM history GROUP BY user_id),
cases AS (
  SELECT user_id, item_id AS positive_item, history_size
  FROM usage JOIN history_sizes USING (user_id) WHERE in_test AND NOT in_history)
"""


def _evaluation(spark: SparkSession, sf: str) -> rk.Evaluation:
    return rk.evaluation_cases(baskets(spark, sf), vectors(spark, sf))


@query("evaluation_cases", f"{_USAGE_SQL} SELECT user_id, positive_item, history_size FROM cases")
def evaluation_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluation(spark, sf).cases


@query(
    "evaluation_cases_first_users",
    f"""{_USAGE_SQL}, first_users AS (
      SELECT user_id FROM headers WHERE is_target ORDER BY user_id LIMIT 1000)
    SELECT user_id, positive_item, history_size FROM cases
    WHERE user_id IN (SELECT user_id FROM first_users)""",
)
def evaluation_cases_first_users(spark: SparkSession, sf: str) -> DataFrame:
    """The bounded evaluation over the first thousand users."""
    return rk.evaluation_cases(
        baskets(spark, sf), vectors(spark, sf), max_users=1000
    ).cases


@query("user_history", f"{_USAGE_SQL} SELECT user_id, item_id, times FROM history")
def user_history(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluation(spark, sf).history


@query(
    "case_statistics",
    f"""{_USAGE_SQL} SELECT count(*) AS test_cases, round(avg(history_size), 6) AS avg_history,
      min(history_size) AS min_history, max(history_size) AS max_history FROM cases""",
)
def case_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rk.case_statistics(_evaluation(spark, sf)).withColumn(
        "avg_history", rounded("avg_history")
    )


@query(
    "leakage_count",
    f"""{_USAGE_SQL} SELECT count(*) AS data_leakage_detected FROM usage
    WHERE in_history AND in_test""",
)
def leakage_count(spark: SparkSession, sf: str) -> DataFrame:
    return rk.leakage_count(_evaluation(spark, sf))


@query(
    "skipped_cases",
    f"""{_USAGE_SQL} SELECT count(*) FILTER (
      history_size + 1 + 99 > (SELECT count(*) FROM vectors)) AS skipped FROM cases""",
)
def skipped_cases(spark: SparkSession, sf: str) -> DataFrame:
    return rk.skipped_cases(_evaluation(spark, sf), vectors(spark, sf))


_DRAW = long_of("md5(concat_ws('|', '42', user_id, positive_item, k))")
# the oracle reads a fixed, generous stretch of each case's draw stream
_CANDIDATES_SQL = f"""{_USAGE_SQL},
places AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM vectors),
drawable AS (SELECT * FROM cases WHERE history_size + 100 <= (SELECT count(*) FROM places)),
draws AS (
  SELECT user_id, positive_item, k, {_DRAW} % (SELECT count(*) FROM places) AS pos
  FROM drawable, range(700) r(k)),
firsts AS (
  SELECT user_id, positive_item, item_id, min(k) AS k FROM draws JOIN places USING (pos)
  GROUP BY user_id, positive_item, item_id),
free AS (
  SELECT f.*, row_number() OVER (PARTITION BY user_id, positive_item ORDER BY k) AS rn
  FROM firsts f WHERE item_id <> positive_item AND NOT EXISTS (
    SELECT 1 FROM history h WHERE h.user_id = f.user_id AND h.item_id = f.item_id)),
candidates AS (
  SELECT user_id, positive_item, item_id FROM free WHERE rn <= 99
  UNION ALL SELECT user_id, positive_item, positive_item FROM drawable)
"""


def _candidates(spark: SparkSession, sf: str) -> tuple[rk.Evaluation, DataFrame]:
    cases = _evaluation(spark, sf)
    return cases, rk.sample_candidates(cases, vectors(spark, sf))


@query(
    "ranking_candidates", f"{_CANDIDATES_SQL} SELECT user_id, positive_item, item_id FROM candidates"
)
def ranking_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf)[1].select(
        "user_id", "positive_item", F.explode("candidates").alias("item_id")
    )


_RANDOM_DIGEST = "md5(concat_ws('|', '42', 'rank', user_id, positive_item, item_id))"
_RANDOM_SQL = f"""scored AS (
  SELECT user_id, positive_item, item_id,
    -('0x' || substr({_RANDOM_DIGEST}, 1, 13))::BIGINT AS score FROM candidates)"""
_FREQUENCY_SQL = """scored AS (
  SELECT c.user_id, positive_item, c.item_id, coalesce(times, 0) AS score FROM candidates c
  LEFT JOIN history h ON h.user_id = c.user_id AND h.item_id = c.item_id)"""
_EMBEDDING_SQL = """profile_long AS (
  SELECT user_id, d, avg(x) AS x FROM (
    SELECT user_id, generate_subscripts(v, 1) AS d, unnest(v) AS x
    FROM history JOIN vectors USING (item_id)) GROUP BY user_id, d),
profiles AS (SELECT user_id, list(x ORDER BY d) AS p FROM profile_long GROUP BY user_id),
scored AS (
  SELECT user_id, positive_item, item_id, list_cosine_similarity(p, v) AS score
  FROM candidates JOIN profiles USING (user_id) JOIN vectors USING (item_id))"""
_RANKS_SQL = """ranks AS (
  SELECT c.user_id, c.positive_item, 1 + count(*) FILTER (o.score > c.score
      OR (o.score = c.score AND o.item_id < c.item_id)) AS rank
  FROM scored c JOIN scored o ON o.user_id = c.user_id AND o.positive_item = c.positive_item
  WHERE c.item_id = c.positive_item GROUP BY c.user_id, c.positive_item)"""
_METRICS = """round(count(*) FILTER (rank <= 10) / count(*)::DOUBLE, 6) AS hit_rate,
  count(*) FILTER (rank <= 10) AS total_hits, count(*) AS total_tests,
  round(avg(rank), 6) AS avg_rank, round(median(rank), 6) AS median_rank,
  round(count(*) FILTER (rank <= 1) / count(*)::DOUBLE, 6) AS hit1,
  round(count(*) FILTER (rank <= 5) / count(*)::DOUBLE, 6) AS hit5"""
_RANKERS = {"random": _RANDOM_SQL, "frequency": _FREQUENCY_SQL, "embedding": _EMBEDDING_SQL}


def _ranks_sql(method: str) -> str:
    return f"""{_CANDIDATES_SQL}, {_RANKERS[method]}, {_RANKS_SQL}
    SELECT user_id, positive_item, rank::INTEGER AS rank FROM ranks"""


@query("ranks_random", _ranks_sql("random"))
def ranks_random(spark: SparkSession, sf: str) -> DataFrame:
    return rk.positive_ranks(rk.rank_random()(_candidates(spark, sf)[1]))


@query("ranks_frequency", _ranks_sql("frequency"))
def ranks_frequency(spark: SparkSession, sf: str) -> DataFrame:
    cases, candidates = _candidates(spark, sf)
    return rk.positive_ranks(rk.rank_frequency(cases.history)(candidates))


@query("ranks_embedding", _ranks_sql("embedding"))
def ranks_embedding(spark: SparkSession, sf: str) -> DataFrame:
    cases, candidates = _candidates(spark, sf)
    return rk.positive_ranks(
        rk.rank_embedding(cases.history, vectors(spark, sf))(candidates)
    )


@query("ranks_embedding_joined", _ranks_sql("embedding"))
def ranks_embedding_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranks by the join path taken for item matrices too large to share."""
    items = vectors(spark, sf)
    return _ranks_in_cells(spark, sf, lambda data: rk.evaluation_cases(data, items), items)


def _ranks_in_cells(
    spark: SparkSession, sf: str, evaluation_of: Callable[[Baskets], rk.Evaluation], catalogue: DataFrame
) -> DataFrame:
    """Ranks by the join path; tables on the way are deleted as soon as a step is done."""
    items = vectors(spark, sf)
    with passing(spark):
        with passing(spark):
            data = baskets(spark, sf)
            with outliving():
                cases = evaluation_of(data)
        with outliving():
            return rk.ranks_in_parts(
                cases, catalogue, lambda part: rk.rank_embedding(part.history, items, limit_bytes=0)
            )


# cases over everything sold, whether or not the catalogue or the vectors know it
_OPEN_USAGE_SQL = _USAGE_SQL.replace(" WHERE item_id IN (SELECT item_id FROM vectors)", "")


def _open_candidates_sql(catalogue: str) -> str:
    rest = _CANDIDATES_SQL.removeprefix(_USAGE_SQL)
    drawable = """inside AS (
  SELECT user_id, count(*) AS n FROM history JOIN places USING (item_id) GROUP BY user_id),
drawable AS (
  SELECT c.user_id, c.positive_item FROM cases c LEFT JOIN inside USING (user_id)
  WHERE coalesce(n, 0) + (positive_item IN (SELECT item_id FROM places))::INTEGER + 99
    <= (SELECT count(*) FROM places)),
draws AS ("""
    start, stop = rest.index("drawable AS"), rest.index("draws AS (") + len("draws AS (")
    opened = rest[:start] + drawable + rest[stop:]
    return f"{_OPEN_USAGE_SQL}{opened.replace('FROM vectors),', f'FROM {catalogue}),')}"


def _open_evaluation(spark: SparkSession, sf: str) -> rk.Evaluation:
    return rk.evaluation_cases(baskets(spark, sf))


@query(
    "ranking_candidates_foreign",
    f"""{_open_candidates_sql('vectors')}
    SELECT user_id, positive_item, item_id FROM candidates""",
)
def ranking_candidates_foreign(spark: SparkSession, sf: str) -> DataFrame:
    """Histories and positives with items that the catalogue does not have."""
    return rk.sample_candidates(_open_evaluation(spark, sf), vectors(spark, sf), keep=False).select(
        "user_id", "positive_item", F.explode("candidates").alias("item_id")
    )


_GAPS_SQL = f"""{_open_candidates_sql('vocab')}, {_EMBEDDING_SQL.split('scored AS')[0]}scored AS (
  SELECT c.user_id, positive_item, item_id, coalesce(list_cosine_similarity(p, v), 0) AS score
  FROM candidates c LEFT JOIN profiles USING (user_id) LEFT JOIN vectors USING (item_id)),
{_RANKS_SQL} SELECT user_id, positive_item, rank::INTEGER AS rank FROM ranks"""


@query("ranks_embedding_gaps", _GAPS_SQL)
def ranks_embedding_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates from everything sold, of which only some items have vectors."""
    cases = _open_evaluation(spark, sf)
    sold = distinct_items(basket_items(spark, sf))
    items = vectors(spark, sf)
    ranker = rk.rank_embedding(cases.history, items)
    shared = rk.matrix_bytes(items, "embedding") <= rk.SHARED_MATRIX_BYTES
    profiles = rk.packed_profiles(rk.user_profiles(cases.history, items)) if shared else None
    return rk.positive_ranks(ranker(rk.sample_candidates(cases, sold, facts=profiles, keep=not shared)))


@query("ranks_embedding_gaps_joined", _GAPS_SQL)
def ranks_embedding_gaps_joined(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks_in_cells(spark, sf, rk.evaluation_cases, distinct_items(basket_items(spark, sf)))


@query("ranks_reduced")
def ranks_reduced(spark: SparkSession, sf: str) -> DataFrame:
    items = vectors(spark, sf)
    reduced = linalg.project(items, linalg.truncated_svd(items, 10)).select("item_id", "reduced")
    cases, candidates = _candidates(spark, sf)
    return rk.positive_ranks(rk.rank_embedding(cases.history, reduced, "reduced")(candidates))


_CENTRED_SQL = f"""means AS (
  SELECT d, avg(x) AS m FROM (
    SELECT generate_subscripts(v, 1) AS d, unnest(v) AS x FROM vectors) GROUP BY d),
centred AS (
  SELECT item_id, list(x - m ORDER BY d) AS v FROM (
    SELECT item_id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM vectors)
  JOIN means USING (d) GROUP BY item_id),
{_EMBEDDING_SQL.replace('JOIN vectors USING', 'JOIN centred USING')}"""


@query(
    "ranks_reduced_full",
    f"""{_CANDIDATES_SQL}, {_CENTRED_SQL}, {_RANKS_SQL}
    SELECT user_id, positive_item, rank::INTEGER AS rank FROM ranks""",
)
def ranks_reduced_full(spark: SparkSession, sf: str) -> DataFrame:
    """At full width the reduction is a rotation, so ranks are those of centred vectors."""
    items = vectors(spark, sf)
    width = items.agg(F.max(F.size("embedding"))).first()[0]
    model = linalg.truncated_svd(items, width)
    reduced = linalg.project(items, model).select("item_id", "reduced")
    cases, candidates = _candidates(spark, sf)
    return rk.positive_ranks(rk.rank_embedding(cases.history, reduced, "reduced")(candidates))


@query(
    "parsing_report",
    f"""{_USAGE_SQL}, targets AS (
      SELECT user_id, n_baskets FROM headers WHERE is_target)
    SELECT count(*) AS total_rows, count(*) FILTER (n_baskets >= 3) AS valid_sequences,
      count(*) FILTER (n_baskets < 3) AS invalid_sequences,
      (SELECT count(*) FROM usage WHERE in_history AND in_test) AS data_leakage_detected,
      (SELECT count(*) FROM cases) AS test_cases FROM targets""",
)
def parsing_report(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that reading the sequences found out, in one row."""
    data = baskets(spark, sf)
    found = rk.evaluation_cases(data, vectors(spark, sf))
    return rk.parsing_report(data, found)


def _metrics_sql() -> str:
    ctes, rows = [], []
    for method, scored in _RANKERS.items():
        ctes.append(scored.replace("scored AS", f"scored_{method} AS"))
        ctes.append(
            _RANKS_SQL.replace("ranks AS", f"ranks_{method} AS").replace(
                "scored ", f"scored_{method} "
            )
        )
        rows.append(f"SELECT '{method}' AS method, {_METRICS} FROM ranks_{method}")
    return f"""{_CANDIDATES_SQL}, {', '.join(ctes)},
results AS ({' UNION ALL '.join(rows)})"""


def _flat_metrics(results: DataFrame) -> DataFrame:
    return results.withColumns(
        {c: rounded(c) for c in ("hit_rate", "avg_rank", "median_rank", "hit1", "hit5")}
    )


def _results(spark: SparkSession, sf: str) -> DataFrame:
    cases, candidates = _candidates(spark, sf)
    return rk.evaluate(
        candidates,
        {
            "random": rk.rank_random(),
            "frequency": rk.rank_frequency(cases.history),
            "embedding": rk.rank_embedding(cases.history, vectors(spark, sf)),
        },
        skipped=rk.skipped_cases(cases, vectors(spark, sf)),
    )


@query(
    "method_metrics",
    f"""{_metrics_sql()} SELECT *, (SELECT count(*) FROM cases)
      - (SELECT count(*) FROM drawable) AS skipped FROM results""",
)
def method_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_metrics(_results(spark, sf))


@query(
    "method_comparison",
    f"""{_metrics_sql()} SELECT method, hit_rate, total_hits, total_tests,
      round(total_hits * 100.0::DOUBLE / total_tests, 4) AS hit_rate_percent,
      row_number() OVER (ORDER BY total_hits DESC, method)::INTEGER AS place,
      CASE method WHEN 'random' THEN
          CASE WHEN abs(hit_rate * 100 - 10) > 3 THEN 'unusual' ELSE 'correct' END
        WHEN 'frequency' THEN CASE WHEN hit_rate > 0.5 THEN 'too high'
          WHEN hit_rate < 0.05 THEN 'correct' ELSE 'reasonable' END
        ELSE CASE WHEN hit_rate >= 0.5 THEN 'good' WHEN hit_rate >= 0.3 THEN 'moderate'
          ELSE 'low' END END AS verdict,
      'embedding' AS best_embedding FROM results""",
)
def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rk.compare(_results(spark, sf)).select(
        "method",
        rounded("hit_rate").alias("hit_rate"),
        "total_hits",
        "total_tests",
        rounded("hit_rate_percent", 4).alias("hit_rate_percent"),
        "place",
        "verdict",
        "best_embedding",
    )


@query("ranker_comparison_job")
def ranker_comparison_job(spark: SparkSession, sf: str) -> DataFrame:
    """The whole evaluation with all four rankers, the reduced space included."""
    return compare_rankers(baskets(spark, sf), vectors(spark, sf))[1]


@query(
    "reciprocal_rank",
    f"""{_CANDIDATES_SQL}, {_RANDOM_SQL}, {_RANKS_SQL}
    SELECT round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM ranks""",
)
def reciprocal_rank(spark: SparkSession, sf: str) -> DataFrame:
    ranks = rk.positive_ranks(rk.rank_random()(_candidates(spark, sf)[1]))
    return mt.mean_reciprocal_rank(ranks).withColumn("mrr", rounded("mrr"))


@query(
    "user_profiles",
    f"""{_USAGE_SQL} SELECT user_id, d - 1 AS d, round(avg(x), 6) + 0 AS x FROM (
      SELECT user_id, generate_subscripts(v, 1) AS d, unnest(v) AS x
      FROM history JOIN vectors USING (item_id)) GROUP BY user_id, d""",
)
def user_profiles(spark: SparkSession, sf: str) -> DataFrame:
    profiles = rk.user_profiles(_evaluation(spark, sf).history, vectors(spark, sf))
    return profiles.select("user_id", F.posexplode("profile").alias("d", "x")).select(
        "user_id", F.col("d").cast("bigint").alias("d"), rounded("x").alias("x")
    )


_POPULAR_SQL = f"""WITH {BASKETS_SQL}, popular AS (
  SELECT item_id, row_number() OVER (ORDER BY frequency DESC, item_id) AS rank FROM vocab),
recommended AS (
  SELECT user_id, item_id, rank FROM headers, popular WHERE is_target AND rank <= 50)"""
_NEAREST_SQL = f"""{_USAGE_SQL}, {_EMBEDDING_SQL.split('scored AS')[0].rstrip().rstrip(',')},
recommended AS (
  SELECT user_id, item_id, rank FROM (
    SELECT user_id, item_id, row_number() OVER (
      PARTITION BY user_id ORDER BY list_cosine_similarity(p, v) DESC, item_id) AS rank
    FROM profiles, vectors) WHERE rank <= 50)"""
_LIST_METRICS_SQL = """, relevant AS (
  SELECT user_id, item_id FROM headers JOIN items USING (basket_id) WHERE is_target),
cutoffs AS (SELECT unnest([1, 5, 10, 15, 20, 50]) AS k),
hits AS (
  SELECT r.user_id, k, count(*) AS n, count(rank) FILTER (rank <= k) AS hits,
    coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= k), 0) AS dcg,
    min(rank) FILTER (rank <= k) AS first_hit
  FROM relevant r CROSS JOIN cutoffs
  LEFT JOIN recommended m ON m.user_id = r.user_id AND m.item_id = r.item_id
  GROUP BY r.user_id, k),
ideal AS (
  SELECT n, sum(1 / log2(i + 1.0::DOUBLE)) AS idcg FROM range(1, 51) a(n), range(1, 51) b(i)
  WHERE i <= n GROUP BY n)
SELECT k, round(avg(hits / k::DOUBLE), 6) AS precision, round(avg(hits / h.n::DOUBLE), 6) AS recall,
  round(avg((hits > 0)::INTEGER), 6) AS hit, round(avg(dcg / idcg), 6) AS ndcg,
  round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 6) AS mrr, count(*) AS samples
FROM hits h JOIN ideal ON ideal.n = least(h.n, k) GROUP BY k"""


def _flat_list_metrics(report: DataFrame) -> DataFrame:
    return report.withColumns(
        {c: rounded(c) for c in ("precision", "recall", "hit", "ndcg", "mrr")}
    )


@query("popularity_list_metrics", f"{_POPULAR_SQL}{_LIST_METRICS_SQL}")
def popularity_list_metrics(spark: SparkSession, sf: str) -> DataFrame:
    data = baskets(spark, sf)
    return _flat_list_metrics(
        mt.ranking_metrics(mt.recommend_popular(data, 50), mt.target_items(data))
    )


def _nearest(spark: SparkSession, sf: str, data: Baskets | None = None) -> DataFrame:
    items = vectors(spark, sf)
    cases = rk.evaluation_cases(data or baskets(spark, sf), items)
    profiles = rk.user_profiles(cases.history, items)
    return mt.recommend_nearest(profiles, items, 50)


@query("nearest_items", f"{_NEAREST_SQL} SELECT user_id, item_id, rank::INTEGER AS rank FROM recommended")
def nearest_items(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf)


@query("nearest_list_metrics", f"{_NEAREST_SQL}{_LIST_METRICS_SQL}")
def nearest_list_metrics(spark: SparkSession, sf: str) -> DataFrame:
    data = baskets(spark, sf)
    return _flat_list_metrics(
        mt.ranking_metrics(_nearest(spark, sf, data), mt.target_items(data))
    )


@query(
    "item_coverage",
    f"""{_NEAREST_SQL} SELECT count(DISTINCT item_id) AS recommended_items,
      round(count(DISTINCT item_id) / (SELECT count(*) + 2 FROM vocab)::DOUBLE, 6) AS item_coverage
    FROM recommended""",
)
def item_coverage(spark: SparkSession, sf: str) -> DataFrame:
    size = distinct_items(basket_items(spark, sf)).count() + 2
    return mt.item_coverage(_nearest(spark, sf), size).withColumn(
        "item_coverage", rounded("item_coverage")
    )


@query(
    "recommendation_entropy",
    f"""{_NEAREST_SQL}, shares AS (
      SELECT count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM recommended GROUP BY item_id)
    SELECT round(-sum(p * log2(p)), 6) AS recommendation_entropy FROM shares""",
)
def recommendation_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return mt.recommendation_entropy(_nearest(spark, sf)).withColumn(
        "recommendation_entropy", rounded("recommendation_entropy")
    )
