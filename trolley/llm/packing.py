"""Best-fit packing of token sequences, bulk-synchronous over runs of equal gaps.

Documents are range-sorted by length, the longest first. A round takes all documents
of one length: a sweep finds the smallest gap that still holds them, the documents with
the lowest ranks get it, one document per gap, the gaps shrink, and the rest go on to
the next gap; only when no gap is left do they open sequences. Gaps are kept as runs of
equally filled sequences, so a round costs as many steps as there are runs, whatever
the number of documents: the state is bounded by the capacity and not by the data.
Documents then find their place by rank, each partition on its own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.spans import SMALL_SLICE, slices
from trolley.llm.tokens import encoder
from trolley.operators.position import with_positions
from trolley.storage import written

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, added_tokens: bool = False
) -> DataFrame:
    """The pieces of every document: its ids, then id 0, cut every ``capacity`` tokens."""
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added_tokens)
        for batch in batches:
            names = batch.column(0)
            for first, data, offsets in slices(batch.column(1), SMALL_SLICE):
                ids, bounds = encode(data, offsets)
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for row in range(len(offsets) - 1):
                    own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(0))
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append(first + row)
                        pieces.append(piece)
                        starts.append(at)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(rows, pa.int64())),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, PIECES.replace("bigint", kind, 1))


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where the documents of each rank go: rows ``(rank, sequence, offset)``, by rank.

    ``counts`` has the number of documents per length; ranks count from the longest. A
    row holds for its rank and all up to the next row's: rank + i goes to sequence + i.
    """
    gaps: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []
    plan: list[tuple[int, int, int]] = []
    rank = opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap not in gaps:
            gaps[gap] = deque()
            insort(sizes, gap)
        gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        waiting = counts[length]
        while waiting:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                fit = capacity // length
                n = min(waiting, -(-waiting // fit))
                plan.append((rank, opened, 0))
                if capacity - length:
                    put(capacity - length, opened, n)
                opened += n
            else:
                gap = sizes[at]
                first, free = gaps[gap].popleft()
                n = min(waiting, free)
                if n < free:
                    gaps[gap].appendleft((first + n, free - n))
                elif not gaps[gap]:
                    del gaps[gap], sizes[at]
                plan.append((rank, first, capacity - gap))
                if gap - length:
                    put(gap - length, first, n)
            rank += n
            waiting -= n
    return np.array(plan, np.int64).reshape(-1, 3)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is the single id 0. Rows are packed one by one, so repeated rows and null
    ids are kept as they are; an empty table gives no pieces. Documents of any length
    are cut into pieces of ``capacity`` tokens, shorter ones are never cut. With
    ``added_tokens`` the contents of the tokenizer's added tokens are those tokens, as in
    an untouched tokenizer; without, they are plain text. Other columns are not read. The files of ``tokenizer`` must be at the same path on every machine.
    """
    pieces = written(
        token_pieces(docs, tokenizer, capacity, id_col, text_col, added_tokens)
        .withColumn("shorter", F.lit(capacity) - F.col("length"))
        .withColumn("row", F.monotonically_increasing_id()),
        "pack-pieces",
    )
    # at most one count per length, so at most ``capacity`` of them
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    ranks, sequences, offsets = plan.T

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column("rank"))
            at = np.searchsorted(ranks, rank, "right") - 1
            found = [
                *[batch.column(i) for i in range(batch.num_columns - 1)],
                pa.array(sequences[at] + rank - ranks[at]),
                pa.array(offsets[at]),
            ]
            yield pa.RecordBatch.from_arrays(found, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = with_positions(pieces, ["shorter", "row"], "rank").drop("shorter", "row")
    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes[:-1]) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)
