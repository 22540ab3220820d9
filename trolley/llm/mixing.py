"""Mixing sources to target weights by hash thresholds, in DataFrame operations alone.

Each document has a fixed 60-bit hash. The share of a source that the mix takes once
more than the rest is the documents whose hash lies below a threshold; the threshold
is found from a histogram of sizes by source and hash bucket. Only the bucket that
holds the boundary is looked at again, in finer buckets, until one hash value is left.
Rows that share it, equal in id and text, are then split in the same way by a second
hash stored with each row, so that no id and no group of copies is taken as one.
Nothing is sorted by document, and the driver sees single numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.functions.hashing import hash_to_long, keyed_hash
from trolley.operators.position import with_positions
from trolley.operators.skew import attach_by_key
from trolley.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 4
HASH_BITS = 60
STEP_BITS = 12


def word_count(text: str | Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for a null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """``(no_source, source, rows, source_size, target)`` per source.

    Sources in code point order, null last, get the weights in turn. Targets share the
    sum of all sizes by weight; one that exceeds ``max_repeat`` times its source's size
    stops there, and the excess goes to the others by weight until none is above. The
    rounds exchange sums only, so any number of sources will do.
    """
    placed = with_positions(
        sizes.groupBy("no_source", "source").agg(
            F.count("*").alias("rows"), F.sum("size").alias("source_size")
        ),
        ["no_source", "source"],
        "place",
    )
    turn = F.array(*[F.lit(w) for w in weights])
    placed = placed.withColumn(
        "weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int"))
    ).withColumn("most", F.col("source_size") * max_repeat)
    words, weight = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_weight = words or 0, weight or 1
    while True:
        above = F.col("most") < F.lit(float(left)) / F.lit(open_weight) * F.col("weight")
        capped, still_open = placed.agg(
            F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        now = ((words or 0) - (capped or 0), still_open or 1)
        if now == (left, open_weight):
            break
        left, open_weight = now
    share = F.lit(float(left)) / F.lit(open_weight) * F.col("weight")
    target = F.when(F.col("most") < share, F.col("most").cast("double")).otherwise(share)
    return placed.select("no_source", "source", "rows", "source_size", target.alias("target"))


def _boundary(rows: DataFrame, budget: DataFrame, value: str) -> DataFrame:
    """Where the budgets end among the values of ``value``, one row per source at most.

    ``budget`` has the words that a source has left (``rest``) and a ``prefix`` of 0. The
    result has the boundary's value as ``at``, its words and rows, the budget left for it
    and its least ``spare``.
    """
    keys = ["no_source", "source"]
    found = None
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        here = rows.withColumn("bucket", F.shiftright(value, bits))
        if found is not None:
            # only rows of the boundary buckets go on; the source is spread over many buckets
            here = here.withColumn("prefix", F.shiftright(value, bits + STEP_BITS)).join(
                budget.select(*keys, "prefix"), [*keys, "prefix"], "left_semi"
            )
        histogram = here.groupBy(*keys, "bucket").agg(
            F.sum("size").alias("words"),
            F.count("*").alias("rows"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.min("spare").alias("least"),
        )
        upto = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        edge = written(
            histogram.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
            .join(budget.drop("prefix"), keys)
            .where("before <= rest AND rest < before + words")
            .withColumn("rest", F.col("rest") - F.col("before")),
            "mix-edges",
        )
        done = edge.where("low = high").select(
            *keys, F.col("low").alias("at"), "rest", "words", "rows", "least"
        )
        found = done if found is None else found.unionByName(done)
        budget = edge.where("low < high").select(*keys, "rest", F.col("bucket").alias("prefix"))
        if budget.isEmpty():
            break
    return found


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds to each source ``whole`` (times that all of it is taken) and its cut.

    A row is taken once more if ``(hash, spare)`` is below ``(cut, spare_cut)``, or equal
    to it with ``at_cut``, which holds when that brings the source nearer to its target.
    """
    keys = ["no_source", "source"]
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    targets = written(
        targets.withColumn("whole", whole.cast("bigint")).withColumn(
            "rest", F.col("target") - F.col("whole") * F.col("source_size")
        ),
        "mix-targets",
    )
    start = F.lit(0).cast("bigint").alias("prefix")
    filled = sized.where("size > 0")
    edge = written(
        _boundary(filled, targets.where("rest > 0").select(*keys, "rest", start), "hash"), "mix-cuts"
    )
    nearer = (F.col("rest") * 2 > F.col("words")).alias("at_cut")
    cuts = edge.where("rows = 1").select(
        *keys, F.col("at").alias("cut"), F.col("least").alias("spare_cut"), nearer
    )
    shared = edge.where("rows > 1")
    if not shared.isEmpty():
        at = shared.select(*keys, F.col("at").alias("hash"))
        equal = filled.join(at, [*keys, "hash"], "left_semi")
        split = _boundary(equal, shared.select(*keys, "rest", start), "spare")
        cuts = cuts.unionByName(
            split.select(*keys, F.col("at").alias("spare_cut"), nearer)
            .join(at, keys)
            .withColumnRenamed("hash", "cut")
        )
    none = F.lit(-1).cast("bigint")
    return targets.join(cuts, keys, "left").select(
        *keys,
        "rows",
        "source_size",
        "target",
        "whole",
        F.coalesce("cut", none).alias("cut"),
        F.coalesce("spare_cut", none).alias("spare_cut"),
        F.coalesce("at_cut", F.lit(False)).alias("at_cut"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
    carry: dict[str, str] | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, ``taken`` and ``copies``.

    ``copies`` is how often the mix takes the row, ``taken`` the words that makes.
    ``size`` defaults to the words of ``text_col``. ``taken`` is a multiple of the size,
    from 0 to ``max_repeat`` times it. Null or empty texts have size 0 and are taken as 0;
    a null id is an id like any other, a null source is the last source. The hash is of
    id and text, so rows that share an id, null included, are taken one by one; of rows
    equal in both as many are taken as the budget holds, by a hash of their carried
    columns, and of wholly equal rows it makes no difference which. An empty table gives an empty result. Columns beyond
    those named are ignored; ``carry`` maps further columns to names that the result keeps.
    """
    size = word_count(text_col) if size is None else size
    parts = [
        F.coalesce(F.col(id_col).cast("string"), F.lit("none")),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))),
    ]
    # rows equal in id and text go by their other columns, then by a stored row number
    others = [F.col(c).alias(name) for c, name in (carry or {}).items() if c not in (id_col, text_col)]
    told = F.md5(F.to_json(F.struct(*others)) if others else F.lit(""))
    numbered = F.concat(
        F.substring(told, 1, 8), keyed_hash(seed, F.monotonically_increasing_id().cast("string"))
    )
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            size.cast("bigint").alias("size"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            hash_to_long(keyed_hash(seed, *parts)).alias("hash"),
            hash_to_long(numbered).alias("spare"),
            *[F.col(c).alias(name) for c, name in (carry or {}).items()],
        ),
        "mix-sizes",
    )
    cuts = thresholds(sized, source_targets(sized, weights, max_repeat))
    nearer = (F.col("spare") == F.col("spare_cut")) & F.col("at_cut")
    extra = (F.col("hash") < F.col("cut")) | (
        (F.col("hash") == F.col("cut")) & ((F.col("spare") < F.col("spare_cut")) | nearer)
    )
    times = F.col("whole") + F.when(extra, 1).otherwise(0)
    return attach_by_key(sized, cuts, ["no_source", "source"], "rows").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * times).alias("taken"),
        times.cast("int").alias("copies"),
        *(carry or {}).values(),
    )


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'none') || '|'
      || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY no_source, src),
filled AS (
  SELECT *, 3 * source_size AS most,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share,
    row_number() OVER (ORDER BY 3 * source_size / weight, no_source, src) AS turn
  FROM sources
  WINDOW before AS (ORDER BY 3 * source_size / weight, no_source, src
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min_by(share, turn) FILTER (most >= share * weight) AS share FROM filled),
targets AS (
  SELECT no_source, src, source_size,
    CASE WHEN most < l.share * weight THEN most::DOUBLE ELSE l.share * weight END AS target
  FROM filled, level l),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM targets),
summed AS (
  SELECT *, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY no_source, src ORDER BY hash
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized JOIN budgets USING (no_source, src))
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies
FROM (SELECT *, (whole + CASE
    WHEN upto <= rest THEN 1
    WHEN upto - size <= rest AND (rest - (upto - size)) * 2 > size THEN 1
    ELSE 0 END)::INTEGER AS copies
  FROM summed)
"""


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, all columns: none, once or several times.

    Null texts and texts without words have size 0 and are never cut, so they come as
    often as their source as a whole; null ids and sources, ties, repeated rows and empty
    tables go as in ``mix_sources``. Columns may have any names.
    """
    carry = {c: f"kept_{i}" for i, c in enumerate(docs.columns)}
    mix = mix_sources(docs, id_col, source_col, text_col, None, carry, **options)
    repeated = mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*[F.col(name).alias(c) for c, name in carry.items()])
