"""Text quality by Bradley-Terry ranking of documents.

A document's strength is a weighted sum of what its text looks like. Training compares
a good and a bad document at a time: the chance that the good one wins is the logistic
function of the difference of their strengths, and the weights maximise the likelihood
of all preferences. The cut between good and bad is the quantile of the training
strengths at the share of bad documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.labelled import held_out, sigmoid
from trolley.llm.lookup import content_hash
from trolley.llm.spans import SMALL_SLICE, SPACED, Prefix, lower, slices, words
from trolley.operators.position import with_positions
from trolley.storage import written

# labelled rows of a group, and the pairs drawn in each
GROUP_ROWS = 12_000
PAIRS = 60_000
RIDGE = 1e-3
SEED = 6
# a document at the cut gets this score
CUT_SCORE = 0.3

_MARKS = [b"%", b"*", b"$", b"&", b"#", b"!", b"|", b".", b",", b"\n", b"<>", b"{}[]", b"=_", b"?", b"-/", b":;", b"@"]
# the classes of bytes, no two with a byte in common; 0 is all others
_UPPER, _LOWER_CASE = len(_MARKS) + 1, len(_MARKS) + 2
_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate(_MARKS):
    _CLASS[list(_set)] = _i + 1
_CLASS[0x41:0x5B] = _UPPER
_CLASS[0x61:0x7B] = _LOWER_CASE
_CLASS[0x30:0x3A] = len(_MARKS) + 3
_CLASS[0x80:] = len(_MARKS) + 4
N_CLASSES = len(_MARKS) + 5


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What each text of a slice looks like: shares of marks, letters, repeats and lengths."""
    starts, ends, rows = words(data, offsets, SPACED)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    n = np.maximum(np.diff(rows), 1).astype(float)
    kinds = _CLASS[data]
    cells = np.repeat(np.arange(len(size)) * N_CLASSES, np.diff(offsets)) + kinds
    counts = np.bincount(cells, minlength=len(size) * N_CLASSES).reshape(-1, N_CLASSES)
    columns = list(np.sqrt(counts[:, 1:] / size[:, None]).T)
    low = lower(data)
    hashes = Prefix(low).of(starts, ends)
    lengths = ends - starts
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    uppers = np.concatenate([[0], np.cumsum(kinds == _UPPER)])
    lowers = np.concatenate([[0], np.cumsum(kinds == _LOWER_CASE)])
    shouted = (uppers[ends] - uppers[starts] > 1) & (lowers[ends] == lowers[starts])
    last = data[ends - 1] if len(ends) else data[:0]
    odd_end = np.isin(last, np.frombuffer(b"%*$&#!|", np.uint8))
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(rows[:-1], rows[1:], strict=True)], float)
    columns += [
        np.sqrt(_per_row(same, rows) / n),
        np.sqrt(_per_row(shouted, rows) / n),
        np.sqrt(_per_row(odd_end, rows) / n),
        distinct / n,
        distinct / n * np.log1p(n),
        _per_row(lengths, rows) / n / 10,
        _per_row(lengths * lengths, rows) / n / 100,
        np.log1p(n),
        (np.diff(rows) == 0).astype(float),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Strength:
    """Weights of the standardised features, and the cut between bad and good."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights - self.cut
        return sigmoid(z + np.log(CUT_SCORE / (1 - CUT_SCORE)))


def training_groups(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """All labelled rows outside the held-out fold as groups: (part, n, mean, var, x, good).

    A row holds the features of about ``GROUP_ROWS`` documents in a fixed order, so the
    model does not depend on the partitioning. An id with several labels has the largest,
    an id with several texts the one of the least hash. Only features move, no text.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(2), SMALL_SLICE):
                x = features(data, offsets)
                bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                ids, contents = (batch.column(i).slice(first, len(x)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids, contents, pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))], names=["doc_id", "content", "x"]
                )

    known = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), content_hash(text_col).alias("content"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    seen = texts.mapInArrow(build, f"doc_id {dict(texts.dtypes)['doc_id']}, content bigint, x array<double>")
    rows = written(
        seen.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min_by("x", "content").alias("x")), "quality-features"
    )
    parts = max(1, -(-rows.count() // GROUP_ROWS))

    def pack(group: pa.Table) -> pa.Table:
        x = group["x"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        good = group["label"].to_numpy() > 0
        order = np.lexsort(np.column_stack([x, good.astype(float)]).T)
        x, good = x[order], good[order]
        return pa.table(
            {"part": group["part"][:1], "n": [len(x)], "mean": [x.mean(axis=0)], "var": [x.var(axis=0)],
             "x": [x.tobytes()], "good": [good.tobytes()]}
        )

    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")
    schema = "part int, n bigint, mean array<double>, var array<double>, x binary, good binary"
    return written(rows.select(part, "label", "x").groupBy("part").applyInArrow(pack, schema), "quality-groups")


def _unpacked(batches: Iterator[pa.RecordBatch], centre: np.ndarray, scale: np.ndarray):
    for batch in batches:
        for part, x, good in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "good")), strict=True):
            rows = np.frombuffer(x).reshape(-1, len(centre))
            yield part, np.clip((rows - centre) / scale, -8, 8), np.frombuffer(good, bool)


def _preferences(groups: DataFrame, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, pairs: int, seed: int):
    """Slope and curve of the likelihood of ``pairs`` random (good, bad) pairs in each group, and how many groups have any."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, z, good in _unpacked(batches, centre, scale):
            winners, losers = z[good], z[~good]
            if len(winners) and len(losers):
                rng = np.random.default_rng(seed + part)
                apart = winners[rng.integers(0, len(winners), pairs)] - losers[rng.integers(0, len(losers), pairs)]
                wins = sigmoid(apart @ weights)
                curve = (apart * (wins * (1 - wins))[:, None]).T @ apart
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "slope": [apart.T @ (1 - wins)], "curve": [curve.ravel()]})

    # a few hundred numbers for each group of thousands of rows
    found = groups.select("part", "x", "good").mapInArrow(step, "part int, slope array<double>, curve array<double>")
    rows = sorted(found.collect())
    width = len(weights)
    slope = sum((np.array(r.slope) for r in rows), np.zeros(width))
    return slope, sum((np.array(r.curve).reshape(width, width) for r in rows), np.zeros((width, width))), len(rows)


def _quantile(values: DataFrame, share: float, n: int) -> float:
    """The exact quantile of a column of doubles; between two values their midpoint."""
    at = (n - 1) * share
    low, high = int(np.floor(at)), int(np.ceil(at))
    near = with_positions(values, ["strength"]).where(F.col("pos").isin(low, high)).select("pos", "strength")
    found = dict(tuple(r) for r in near.collect())
    return found[high] - (found[high] - found[low]) * 0.5 if high > low else found[low]


def fit(groups: DataFrame, pairs: int = PAIRS, seed: int = SEED) -> Strength:
    """Bradley-Terry weights by Newton's method over random (good, bad) pairs of every group.

    ``groups`` are those of ``training_groups``. All its rows set the scale, take part
    in the pairs and set the cut; a round of Newton's method is one pass over them.
    """
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    stats = groups.select("part", "n", "mean", "var").orderBy("part").collect()
    n = sum(r.n for r in stats)
    if not n:
        return Strength(np.zeros(width), np.ones(width), np.zeros(width), -1.0)
    share = np.array([r.n for r in stats])[:, None] / n
    means, variances = (np.array([r[c] for r in stats]) for c in ("mean", "var"))
    centre = (share * means).sum(axis=0)
    scale = np.sqrt((share * (variances + (means - centre) ** 2)).sum(axis=0)) + 1e-6
    weights = np.zeros(width)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, z, good in _unpacked(batches, centre, scale):
            yield pa.RecordBatch.from_pydict({"strength": z @ weights, "good": good})

    slope, curve, usable = _preferences(groups, centre, scale, weights, pairs, seed)
    for _ in range(30 if usable else 0):
        many = pairs * usable
        step = np.linalg.solve(curve / many + RIDGE * np.eye(width), slope / many - RIDGE * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
        slope, curve, usable = _preferences(groups, centre, scale, weights, pairs, seed)
    found = groups.select("part", "x", "good").mapInArrow(strengths, "strength double, good boolean")
    n_good = found.where("good").count()
    if 0 < n_good < n:
        cut = _quantile(found.select("strength"), 1 - n_good / n, n)
    else:
        # labels of one kind only: all documents are on its side of the cut
        cut = -1.0 if n_good else 1.0
    return Strength(centre, scale, weights, float(cut))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 from ``CUT_SCORE`` on).

    Only the text counts. All labelled rows outside the held-out fold are learnt from;
    all rows are scored, whole texts each. A null or empty text is
    scored as an empty one, rows with a null id are scored but never learnt from, and
    repeated rows get equal scores. Without usable labels every row is predicted 1. Other
    columns are not read; ``carry`` names columns to keep.
    """
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(carry)]
    model = fit(training_groups(docs, labels, label_col, id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(1), SMALL_SLICE):
                scores = model.scores(features(data, offsets))
                others = [batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)]]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, len(scores)) for c in others], pa.array(scores)],
                    names=[batch.schema.names[0], *batch.schema.names[2:], "score"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text") + ", score double"
    return rows.mapInArrow(score, schema).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"),
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(carry)],
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, all columns."""
    marked = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = dict(zip(docs.columns, marked.columns, strict=True))
    found = score_quality(
        marked, labels, id_col=names[id_col], text_col=names[text_col], carry=tuple(marked.columns), **options
    )
    return found.where("predicted = 1").select(*[F.col(n).alias(c) for c, n in names.items()])
