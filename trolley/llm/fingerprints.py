"""I-Match fingerprints: hashes of a document's terms within lexicons of a chosen band.

The lexicon holds the terms whose inverse document frequency over the whole corpus lies
in a band: not so common that they say nothing, not so rare that a slip changes them.
The fingerprint hashes the sorted distinct terms of a text within many randomised
subsets of the lexicon and within the whole of it; texts that differ a little still
agree on some subsets. A text with too few terms in the band is known by all its terms,
a text without terms by all its bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.lookup import content_hash
from trolley.llm.spans import SPACED, Prefix, lower, mixed, slices, words

# the band, as shares of all documents that hold a term
RAREST = 1 / 2000
COMMONEST = 1 / 4
# a subset keeps one of so many terms; several subsets of each kind
THINNING = (16, 64, 256, 1024)
ROUNDS = 12
# buckets of neighbouring ids per shuffle partition
BUCKETS = 8
# the densest subset keeps one term of this text on average; with fewer all its terms count
LEAST_TERMS = min(THINNING)
_U = np.uint64
_EMPTY = "------"
# hex digits of the thinned subsets; those of the whole lexicon follow
_THINNED = 6 * ROUNDS * len(THINNING)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each text, one after the other, and their row bounds."""
    data = lower(data)
    starts, ends, rows = words(data, offsets, SPACED)
    hashes = Prefix(data).of(starts, ends)
    found = [np.unique(hashes[a:b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    return np.concatenate(found), np.concatenate([[0], np.cumsum([len(f) for f in found])])


def lexicon(docs: DataFrame, rarest: float, commonest: float, text_col: str) -> np.ndarray:
    """Sorted hashes of the terms in the band.

    Each term of the band is in a ``rarest`` share of the documents at least, so there
    are at most (mean distinct terms of a document) / ``rarest`` of them, whatever the
    number of documents; that is what the driver gets and every task is sent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            terms, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(which, np.concatenate([h[1] for h in held]), len(terms)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                held.append(np.unique(_terms(data, offsets)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 3_000_000:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    total = docs.count()
    least, most = max(1, math.ceil(total * rarest)), max(1, math.floor(total * commonest))
    found = (
        docs.select(text_col)
        .mapInArrow(count, "term bigint, n bigint")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n").between(least, most))
        .select("term")
        .toArrow()
    )
    return np.sort(found["term"].to_numpy().view(np.uint64))


def _subset_hashes(terms: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text and lexicon subset a hash of the terms in it, and their number."""
    n, rows = len(bounds) - 1, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes = np.zeros((n, ROUNDS * len(THINNING)), np.uint64)
    sizes = np.zeros(hashes.shape, np.int64)
    for turn in range(ROUNDS):
        draw = mixed(terms + _U(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64)))
        for kind, thin in enumerate(THINNING):
            own = np.flatnonzero((draw >> _U(8 * kind)) % _U(thin) == 0)
            of, cell = rows[own], turn * len(THINNING) + kind
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(draw[own] ^ _U(cell + 1)))])
            upto = np.searchsorted(of, np.arange(n + 1))
            hashes[:, cell] = mixed(sums[upto[1:]] - sums[upto[:-1]])
            sizes[:, cell] = np.diff(upto)
    return hashes, sizes


def fingerprints(column: pa.Array, known: np.ndarray) -> list[str]:
    """The fingerprint of each text: six hex digits per subset, dashes where it has no term, then 16 of all terms."""
    out = []
    for _, data, offsets in slices(column):
        terms, bounds = _terms(data, offsets)
        if len(known):
            at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
            inside = known[at] == terms
        else:
            inside = np.zeros(len(terms), bool)
        few = np.diff(np.concatenate([[0], np.cumsum(inside)])[bounds]) < LEAST_TERMS
        inside |= np.repeat(few, np.diff(bounds))
        bounds = np.concatenate([[0], np.cumsum(inside)])[bounds]
        terms = terms[inside]
        hashes, sizes = _subset_hashes(terms, bounds)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(terms))])
        # prints of all terms differ from prints of the band
        whole = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + few.astype(np.uint64))
        raw = mixed(Prefix(data).of(offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64))
        whole = np.where(np.diff(bounds) > 0, whole, raw)
        for row, filled, w in zip((hashes >> _U(40)).tolist(), (sizes > 0).tolist(), whole.tolist(), strict=True):
            out.append("".join(f"{h:06x}" if f else _EMPTY for h, f in zip(row, filled, strict=True)) + f"{w:016x}")
    return out


def likeness(a: str, b: str) -> float:
    """Share of the subsets that either text has terms in on which the two agree."""
    if a == b:
        return 1.0
    parts = [(a[i : i + 6], b[i : i + 6]) for i in range(0, _THINNED, 6)] + [(a[_THINNED:], b[_THINNED:])]
    used = [x == y for x, y in parts if x != _EMPTY or y != _EMPTY]
    return sum(used) / len(used)


def _key(id_col: str, text_col: str) -> list[Column]:
    """The order of documents: descending ids, null ids last, equal ids by their texts."""
    return [F.col(id_col).isNull().alias("none"), (-F.col(id_col)).alias("down"), content_hash(text_col).alias("content")]


def edited_fingerprints(
    docs: DataFrame,
    rarest: float = RAREST,
    commonest: float = COMMONEST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Fingerprints of all texts and of their edited forms.

    Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has the last third of the code points
    replaced by as many from the start of the next document, in descending order of ids,
    the first following the last; a document alone follows itself. Null texts are empty;
    null ids come last; of equal ids the order is that of a hash of the text, and rows
    equal in both have equal texts. Texts with under ``LEAST_TERMS`` terms in the band
    have fingerprints of all their terms, texts without terms of all their bytes. Ids are whole numbers; other columns are not read.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(lexicon(docs, rarest, commonest, text_col))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = parts * BUCKETS
    # neighbours share a bucket; the head of the next bucket is added to each bucket's end
    cuts = docs.select(F.percentile_approx(id_col, [i / n_buckets for i in range(1, n_buckets)], 20 * n_buckets)).first()[0]
    cuts = sorted(set(cuts or []))
    bucket = F.when(F.col(id_col).isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c > F.col(id_col)))
    )
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_key(id_col, text_col), bucket.alias("bucket"))
    # one row per bucket
    heads = sorted(
        (r["bucket"], r["head"]["none"], r["head"]["down"], r["head"]["content"])
        for r in keyed.groupBy("bucket").agg(F.min(F.struct("none", "down", "content")).alias("head")).collect()
    )
    ends = [(heads[i - 1][0], *h[1:]) for i, h in enumerate(heads)]
    head = spark.createDataFrame(ends, "ended int, head_none boolean, head_down bigint, head_content bigint")
    is_head = (
        F.col("head_none").eqNullSafe(F.col("none"))
        & F.col("head_down").eqNullSafe(F.col("down"))
        & (F.col("head_content") == F.col("content"))
    )
    places = F.filter(
        F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("end")),
            F.struct(F.col("ended").alias("bucket"), F.lit(True).alias("end")),
        ),
        lambda p: p["bucket"].isNotNull(),
    )
    order = ["bucket", "end", "none", "down", "content"]
    sorted_rows = (
        keyed.join(F.broadcast(head), is_head, "left")
        .withColumn("place", F.explode(places))
        .select("doc_id", "text", "none", "down", "content", F.col("place.bucket").alias("bucket"), F.col("place.end").alias("end"))
        .repartition(parts, "bucket")
        .sortWithinPartitions(*order)
        .select("doc_id", "bucket", "end", "text")
    )
    kind = dict(docs.dtypes)[id_col]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        held = None  # the last row so far, which waits for the next
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = pa.Table.from_batches([batch.slice(at, 512)])
                rows = pa.concat_tables([held, part]) if held is not None else part
                held = rows.slice(len(rows) - 1, 1)
                ids = rows["doc_id"].combine_chunks()
                texts = [t or "" for t in rows["text"].to_pylist()]
                bucket, end = rows["bucket"].to_pylist(), rows["end"].to_pylist()
                # an end row follows its bucket's documents; further ones repeat it
                own = [i for i in range(len(rows) - 1) if not end[i] and bucket[i] == bucket[i + 1]]
                if not own:
                    continue
                prints = fingerprints(pa.array(texts), terms)
                edited = [
                    (t := texts[i])[: len(t) - len(t) // 3] + texts[i + 1][: len(t) // 3] for i in own
                ]
                edited_prints = fingerprints(pa.array(edited), terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(own)),
                        pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                        pa.array([prints[i] for i in own]),
                        pa.array(edited_prints),
                        pa.array([likeness(prints[i], e) for i, e in zip(own, edited_prints, strict=True)], pa.float64()),
                        pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = (
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return sorted_rows.mapInArrow(compare, schema)
