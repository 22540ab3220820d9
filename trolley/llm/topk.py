"""Exact top-k search by inner product with MaxScore, in shards.

A dimension is a term, a component its weight, a vector's entries its postings. Within a
shard a term's contribution to a query lies between two bounds. Terms are taken in the
order of the width of these bounds: the essential ones are added up for all vectors of
the shard, and once the rest cannot lift all vectors over the threshold any more, only
vectors that are still competitive are probed for the others. Shards are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.storage import written

SCALE = 256
SHARD_ROWS = 8192
QUERY_ROWS = 4096
STEP = 8
SEEDS = 64
_LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v)`` with components floor(scale * x); rows with a bad one are left out."""
    fine = F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    numbers = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("bigint").alias("vec_id"), numbers.alias("v")
    )


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of components; shorter vectors have no postings for the last terms."""
    column = lists.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    bounds = column.offsets.to_numpy()
    lengths = np.diff(bounds)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    values = column.values.to_numpy()[bounds[0] : bounds[-1]] if len(lengths) else np.zeros(0, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def search_shard(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores of the ``k`` best rows for one query, ties to smaller ids.

    ``rows`` has a column of postings per term. A row of the query's own id takes no part.
    """
    width = min(len(query), rows.shape[0])
    if not width:
        places = np.flatnonzero(ids != query_id)
        places = places[np.argsort(ids[places], kind="stable")][:k]
        return places, np.zeros(len(places), np.int64)
    query, postings = query[:width], rows[:width]
    ends = np.stack([query * postings.min(axis=1), query * postings.max(axis=1)])
    most = ends.max(axis=0)
    order = np.argsort(-(most - ends.min(axis=0)), kind="stable")
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])
    alive = np.flatnonzero(ids != query_id)
    partial = np.zeros(len(alive), np.int64)
    threshold = None
    for at in range(0, width, STEP):
        terms = order[at : at + STEP]
        partial += query[terms] @ (postings[terms] if len(alive) == postings.shape[1] else postings[np.ix_(terms, alive)])
        left = rest[min(at + STEP, width)]
        if len(alive) > SEEDS:
            # the most promising rows in full give the threshold that all others must reach
            seeds = np.argpartition(-partial, SEEDS)[:SEEDS]
            scores = query @ postings[:, alive[seeds]]
            threshold = np.sort(scores)[-k] if threshold is None else max(threshold, np.sort(scores)[-k])
            competitive = partial + left >= threshold
            alive, partial = alive[competitive], partial[competitive]
    best = np.lexsort([ids[alive], -partial])[:k]
    return alive[best], partial[best]


def _wide(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[list, list]:
    """The same for components whose products do not fit 64 bits; scores stop at 64 bits."""
    width = min(len(query), rows.shape[0])
    scores = query[:width].astype(object) @ rows[:width].astype(object) if width else np.zeros(len(ids), object)
    scores = [max(-_LONG - 1, min(_LONG, int(s))) for s in scores]
    found = sorted((-s, i, at) for at, (s, i) in enumerate(zip(scores, ids.tolist(), strict=True)) if i != query_id)[:k]
    return [f[2] for f in found], [-f[0] for f in found]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of ``vectors`` per query.

    The score is the inner product of the components floor(scale * x); vectors that are
    null, without an id, or hold a null or non-finite component take no part. Terms that
    one of two vectors lacks add nothing. A query's own id is no answer to it; an id that
    occurs several times answers as often, and asks once, with its least vector. Ties go
    to the smaller id; a score beyond 64 bits is the largest (or least) of them. Other columns are not read; empty tables give an empty result.
    """
    rows = written(
        whole_numbers(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors"
    )
    asked = written(
        whole_numbers(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "queries"
    )
    n_rows, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, math.ceil(n_rows / SHARD_ROWS)), max(1, math.ceil(n_asked / QUERY_ROWS))
    # every shard meets every block of queries; neither is copied as a whole to one task
    left = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"),
        F.explode(_upto(blocks)).alias("block"),
        "vec_id",
        "v",
    )
    right = asked.select(
        F.explode(_upto(shards)).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"),
        "vec_id",
        "v",
    )

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        ids = shard["vec_id"].to_numpy()
        rows = np.ascontiguousarray(_matrix(shard["v"]).T)
        wanted, vectors = block["vec_id"].to_numpy(), _matrix(block["v"])
        largest = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
        wide = largest(rows) * largest(vectors) * max(rows.shape[0], 1) >= 1 << 62
        out = {"query_id": [], "vec_id": [], "score": []}
        for query_id, query in zip(wanted.tolist() if len(ids) else [], vectors, strict=False):
            at, scores = (_wide if wide else search_shard)(ids, rows, query_id, query, k)
            out["query_id"] += [query_id] * len(at)
            out["vec_id"] += ids[at].tolist()
            out["score"] += list(map(int, scores))
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    )
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q, whole c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
