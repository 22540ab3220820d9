"""Removing byte strings that occur more than once, by suffix arrays of shards.

1. Each text is cut into runs of windows that share their least hash of 50 bytes. Equal
   windows have equal least hashes, so only runs whose hash occurs again anywhere can
   hold a window that does. A run whose whole bytes occur again needs no more work.
2. The undecided windows are cut again by their least hash of 150 bytes, which leaves
   out short phrases and lines that many texts share.
3. What is left, mostly the edges of repeated passages, goes to shards of bounded size.
   Each builds a suffix array by induced sorting and permuted common prefixes, which
   give the classes of equal windows of the shard.
4. Classes of different shards are matched by a 128-bit hash of their window.

No group of equal passages is ever gathered: hashes are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.lookup import content_hash, texts_of
from trolley.llm.spans import SMALL_SLICE, Prefix, mixed, runs, signed, slices
from trolley.llm.suffixes import common_prefixes, suffix_array
from trolley.storage import written

WINDOW = 200
GRAMS = (50, 150)
SHARD_BYTES = 1 << 20

_U = np.uint64
_TWIST = np.random.default_rng(77).permutation(256).astype(np.uint8)


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours, in a doubling number of passes."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out, span = least(out[:-span], out[span:]), span * 2
    rest = width - span
    return least(out[: len(out) - rest], out[rest:]) if rest else out


class WindowRuns:
    """The window runs of all texts of a slice.

    ``first`` and ``last`` are the first and last window of a run, ``gram`` its least
    hash, ``count`` the places of that hash in it, ``row`` the text it belongs to.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.prefix = Prefix(data)
        n, width = len(data), window - gram + 1
        self.first = self.last = self.row = self.count = np.zeros(0, np.int64)
        self.gram = np.zeros(0, np.uint64)
        if n < window:
            return
        at = np.arange(n - gram + 1)
        hashes = self.prefix.of(at, at + gram)
        least = _sliding(hashes, width, np.minimum)
        # windows that end in the next text are none
        lengths = np.diff(offsets)
        valid = np.zeros(n + 1, np.int32)
        whole = lengths >= window
        np.add.at(valid, offsets[:-1][whole], 1)
        np.add.at(valid, offsets[1:][whole] - window + 1, -1)
        valid = np.cumsum(valid[: n - window + 1]).astype(bool)
        change = np.ones(len(valid), bool)
        change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        # texts of exactly one window may lie side by side
        starts = offsets[:-1][whole]
        change[starts] = True
        change &= valid
        self.first = np.flatnonzero(change)
        if not len(self.first):
            return
        until = np.append(self.first[1:], len(valid))
        stop = ~valid
        stop[starts] = True
        ends = np.append(np.flatnonzero(stop), len(valid))
        self.last = np.minimum(until, ends[np.searchsorted(ends, self.first, "right")]) - 1
        self.gram = least[self.first]
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        # places that are least in some valid window
        padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        padded[width - 1 : width - 1 + len(least)] = np.where(valid, least, _U(0))
        places = np.flatnonzero(_sliding(padded, width, np.maximum) == hashes)
        kinds, kind = np.unique(hashes[places], return_inverse=True)
        place_keys = np.sort(kind.astype(np.int64) * (n + 1) + places)
        run_keys = np.searchsorted(kinds, self.gram) * (n + 1)
        self.count = np.searchsorted(place_keys, run_keys + self.last + width - 1, "right") - np.searchsorted(
            place_keys, run_keys + self.first
        )

    def bodies(self, window: int) -> np.ndarray:
        """Hash of all bytes that the windows of a run cover."""
        return self.prefix.of(self.first, self.last + window)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


_HASHES = "ats array<int>, tos array<int>, grams array<bigint>, bodies array<bigint>, places array<int>"
_HASH_NAMES = ["ats", "tos", "grams", "bodies", "places"]


def _hash_columns(found: WindowRuns, row: np.ndarray, base: np.ndarray, rows: int, window: int) -> list[pa.Array]:
    """Per row its runs: first and last window from the start of its text, and their hashes.

    ``row`` is the row of each run, ``base`` where the text of that row starts.
    """
    bounds = np.searchsorted(row, np.arange(rows + 1))
    return [
        _lists((found.first - base).astype(np.int32), bounds),
        _lists((found.last - base).astype(np.int32), bounds),
        _lists(signed(found.gram), bounds),
        _lists(signed(found.bodies(window)), bounds),
        _lists(found.count.astype(np.int32), bounds),
    ]


def run_table(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: row, doc_id, content, n_bytes, sha256 and the hashes of its window runs."""
    kind = dict(docs.dtypes)[id_col]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(2), SMALL_SLICE):
                n = len(offsets) - 1
                found = WindowRuns(data, offsets, window, gram)
                shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array(shas),
                        *_hash_columns(found, found.row, offsets[found.row], n, window),
                    ],
                    names=["doc_id", "content", "n_bytes", "sha", *_HASH_NAMES],
                )

    schema = f"doc_id {kind}, content bigint, n_bytes bigint, sha string, {_HASHES}"
    rows = docs.select(F.col(id_col).alias("doc_id"), content_hash(text_col).alias("content"), F.col(text_col))
    return written(rows.mapInArrow(build, schema).withColumn("row", F.monotonically_increasing_id()), "window-runs")


class _Flags:
    """The flagged runs of the texts of a slice, in windows from the start of their text.

    ``starts``, ``ends`` and ``bounds`` are the byte spans of whole repeats and where each
    text's begin. ``opens``, ``closes`` and ``row`` are the byte spans of the windows sent
    on, with the text of each; spans whose windows lie side by side are one.
    """

    def __init__(self, flags: pa.Array, window: int):
        upto = flags.offsets.to_numpy()
        of = flags.values.slice(upto[0], upto[-1] - upto[0])
        at, to = (of.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        whole, sent = (of.field(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        row = np.repeat(np.arange(len(flags)), np.diff(upto))
        self.starts, self.ends = at[whole], to[whole] + window
        self.bounds = np.searchsorted(row[whole], np.arange(len(flags) + 1))
        at, to, row = at[sent], to[sent], row[sent]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] > to[:-1] + 1) | (row[1:] != row[:-1])
        last = np.append(new[1:], True)[: len(at)]
        self.opens, self.closes, self.row = at[new], to[last] + window, row[new]


def finer_table(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Per text: spans of whole repeats, and the hashes of the finer runs of undecided windows."""
    kind = dict(texts.dtypes)["doc_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(3), SMALL_SLICE):
                n = len(offsets) - 1
                flags = _Flags(batch.column(2).slice(first, n), window)
                # only the bytes of undecided windows are hashed again
                begins = offsets[flags.row] + flags.opens
                lengths = flags.closes - flags.opens
                upto = np.concatenate([[0], np.cumsum(lengths)])
                parts = data[np.repeat(begins - upto[:-1], lengths) + np.arange(upto[-1])]
                fine = WindowRuns(parts, upto, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        _lists(flags.starts.astype(np.int32), flags.bounds),
                        _lists(flags.ends.astype(np.int32), flags.bounds),
                        *_hash_columns(fine, flags.row[fine.row], (upto[:-1] - flags.opens)[fine.row], n, window),
                    ],
                    names=["doc_id", "content", "starts", "ends", *_HASH_NAMES],
                )

    schema = f"doc_id {kind}, content bigint, starts array<int>, ends array<int>, {_HASHES}"
    found = texts.select("doc_id", "content", "runs", "text").mapInArrow(build, schema)
    return written(found.withColumn("row", F.monotonically_increasing_id()), "finer-runs")


def repeated_runs(table: DataFrame) -> DataFrame:
    """Per text with any: its runs whose hash occurs again; which are whole repeats, which go to shards."""
    every = table.select("row", F.explode(F.arrays_zip(*_HASH_NAMES)).alias("of")).select(
        "row",
        F.col("of.ats").alias("at"),
        F.col("of.tos").alias("to"),
        F.col("of.grams").alias("gram"),
        F.col("of.bodies").alias("body"),
        F.col("of.places").alias("places"),
    )
    again = written(
        every.groupBy("gram").agg(F.sum("places").alias("n")).where("n > 1").select("gram"), "repeated-grams"
    )
    found = written(every.drop("places").join(again, "gram"), "repeated-runs")
    bodies = written(
        found.groupBy("gram", "body").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("first")),
        "run-bodies",
    )
    # one copy of a whole repeat joins the shards where an undecided run may hold a part of it
    undecided = bodies.where("n = 1").select("gram").distinct()
    shown = bodies.where("n > 1").join(undecided, "gram", "left_semi").select("first.row", "first.at", F.lit(True).alias("shown"))
    whole = bodies.where("n > 1").select("gram", "body", F.lit(True).alias("whole"))
    flagged = found.join(whole, ["gram", "body"], "left").join(shown, ["row", "at"], "left")
    sent = F.col("whole").isNull() | F.col("shown").isNotNull()
    # one array per text, no longer than the text
    per_row = flagged.groupBy("row").agg(
        F.sort_array(
            F.collect_list(F.struct("at", "to", F.coalesce("whole", F.lit(False)).alias("whole"), sent.alias("sent")))
        ).alias("runs")
    )
    named = table.select("row", "doc_id", "content").join(per_row, "row")
    # of rows equal in id and text the first has the flags of the copy that is shown
    return written(named.groupBy("doc_id", "content").agg(F.min_by("runs", "row").alias("runs")), "run-flags")


def _shard_classes(parts: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows of a shard: the first place, the size and two hashes of each.

    The last array gives the class of every window, in the order of the parts.
    """
    data = np.concatenate(parts)
    sa = suffix_array(data)
    prefixes = common_prefixes(data, sa)
    klass = np.cumsum(prefixes[sa] < window)
    of_place = np.empty(len(data), np.int64)
    of_place[sa] = klass
    lengths = np.array([len(p) for p in parts])
    firsts = np.cumsum(lengths) - lengths
    n = lengths - window + 1
    places = np.repeat(firsts, n) + runs(n)
    _, sample, which, sizes = np.unique(of_place[places], return_index=True, return_inverse=True, return_counts=True)
    at = places[sample]
    one = Prefix(data).of(at, at + window)
    two = mixed(Prefix(_TWIST[data]).of(at, at + window) + _U(window))
    return sample, sizes, np.stack([one, two]), which


def shard_windows(texts: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """Per text: covered spans, and the window classes of its undecided runs.

    ``starts``/``ends`` are spans of bytes that are certain to go. ``at``, ``one``,
    ``two``, ``copies`` are windows that stand for a class of their shard; a class with
    several copies is certain as well, one with a single copy may be met elsewhere.
    """
    kind = dict(texts.dtypes)["doc_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # id, content, spans, [(first window, bytes)]
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            parts = [p for h in held for _, p in h[3]]
            owner = np.repeat(np.arange(len(held)), [sum(len(p) - window + 1 for _, p in h[3]) for h in held])
            where = [a + np.arange(len(p) - window + 1) for h in held for a, p in h[3]]
            where = np.concatenate(where) if where else np.zeros(0, np.int64)
            if parts:
                sample, sizes, hashes, which = _shard_classes(parts, window)
                sure = np.flatnonzero(sizes[which] > 1)
            else:
                sample = sure = np.zeros(0, np.int64)
                sizes, hashes = sample, np.zeros((2, 0), np.uint64)
            order = np.argsort(owner[sample], kind="stable")
            sample, sizes, hashes = sample[order], sizes[order], hashes[:, order]
            by_text = np.searchsorted(owner[sample], np.arange(len(held) + 1))
            sure_by = np.searchsorted(owner[sure], np.arange(len(held) + 1))
            spans = []
            for i, h in enumerate(held):
                a = where[sure[sure_by[i] : sure_by[i + 1]]]
                # windows side by side make one span
                cut = np.flatnonzero(np.diff(a) > 1) + 1 if len(a) else a
                firsts = np.concatenate([a[:1], a[cut]])
                lasts = np.concatenate([a[cut - 1], a[-1:]])
                spans.append(h[2] + list(zip(firsts.tolist(), (lasts + window).tolist(), strict=True)))
            span_bounds = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([h[0] for h in held]),
                    pa.array([h[1] for h in held], pa.int64()),
                    _lists(flat[:, 0].copy(), span_bounds),
                    _lists(flat[:, 1].copy(), span_bounds),
                    _lists(where[sample].astype(np.int32), by_text),
                    _lists(signed(hashes[0].copy()), by_text),
                    _lists(signed(hashes[1].copy()), by_text),
                    _lists(np.minimum(sizes, 2).astype(np.int32), by_text),
                ],
                names=["doc_id", "content", "starts", "ends", "at", "one", "two", "copies"],
            )
            held, size = [], 0
            return out

        for batch in batches:
            ids, contents = batch.column(0), batch.column(1).to_pylist()
            for first, data, offsets in slices(batch.column(3), SMALL_SLICE):
                n = len(offsets) - 1
                flags = _Flags(batch.column(2).slice(first, n), window)
                rest = np.searchsorted(flags.row, np.arange(n + 1))
                for i in range(n):
                    own = slice(flags.bounds[i], flags.bounds[i + 1])
                    spans = list(zip(flags.starts[own].tolist(), flags.ends[own].tolist(), strict=True))
                    own = slice(rest[i], rest[i + 1])
                    text = data[offsets[i] : offsets[i + 1]]
                    regions = [
                        (x, text[x:y].copy())
                        for x, y in zip(flags.opens[own].tolist(), flags.closes[own].tolist(), strict=True)
                    ]
                    held.append((ids.slice(first + i, 1), contents[first + i], spans, regions))
                    size += sum(len(p) for _, p in regions) + 64
                    if size >= shard_bytes:
                        yield flush()
        if held:
            yield flush()

    schema = (
        f"doc_id {kind}, content bigint, starts array<int>, ends array<int>, "
        "at array<int>, one array<bigint>, two array<bigint>, copies array<int>"
    )
    return written(
        texts.select("doc_id", "content", "runs", "text").mapInArrow(build, schema), "shard-windows"
    )


def _removals(
    docs: DataFrame, window: int, grams: tuple[int, int], shard_bytes: int, id_col: str, text_col: str, with_text: bool
) -> tuple[DataFrame, DataFrame]:
    """The run table, and per text that loses bytes what it loses and keeps."""
    table = run_table(docs, window, grams[0], id_col, text_col)
    flags = repeated_runs(table)
    finer = finer_table(texts_of(docs, flags, id_col, text_col), window, grams[1])
    keys = ["doc_id", "content"]
    shards = shard_windows(texts_of(docs, repeated_runs(finer), id_col, text_col), window, shard_bytes)
    single = shards.select(
        "doc_id", "content", F.explode(F.arrays_zip("at", "one", "two", "copies")).alias("of")
    ).select("doc_id", "content", "of.at", "of.one", "of.two", "of.copies")
    met = written(
        single.groupBy("one", "two").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"), "met-windows"
    )
    more = (
        single.where("copies = 1").join(met, ["one", "two"]).groupBy("doc_id", "content").agg(F.collect_set("at").alias("more"))
    )
    known = shards.select(*keys, "starts", "ends").unionByName(finer.select(*keys, "starts", "ends")).groupBy(*keys).agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    both = known.select("doc_id", "content", "starts", "ends", F.lit(None).cast("array<int>").alias("more")).unionByName(
        more.select("doc_id", "content", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("ends"), "more")
    )
    spans = written(
        both.groupBy("doc_id", "content")
        .agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "more")])
        .where("size(starts) + size(more) > 0"),
        "removed-spans",
    )
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            starts, ends, more_at = batch.column(2), batch.column(3), batch.column(4)
            text = batch.column(5).cast(pa.large_binary())
            for i in range(batch.num_rows):
                data = np.frombuffer(text[i].as_buffer(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                at = more_at[i].values.to_numpy()
                np.add.at(edge, np.concatenate([starts[i].values.to_numpy(), at]), 1)
                np.add.at(edge, np.concatenate([ends[i].values.to_numpy(), at + window]), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = data[~gone].tobytes()
                spans_here = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                rows.append((int(gone.sum()), spans_here, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.string()),
                ],
                names=["doc_id", "content", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    removed = texts_of(docs, spans, id_col, text_col).select("doc_id", "content", "starts", "ends", "more", "text").mapInArrow(
        cut, f"doc_id {kind}, content bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"
    )
    digests = ["n_removed", "n_spans", "kept_sha256"]
    one = removed.groupBy("doc_id", "content").agg(
        *[F.first(c).alias(c) for c in (digests + ["kept"] if with_text else digests)]
    )
    return table, one.withColumnRenamed("doc_id", "own_id").withColumnRenamed("content", "own_content")


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    grams: tuple[int, int] = GRAMS,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Remove every byte of a ``window``-byte string that also starts elsewhere in the table.

    Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256
    of the remaining bytes. Strings are judged on the input, overlaps count, matches
    never cross texts; null and empty texts have no bytes. Rows equal in id and text
    remove each other's strings like any other copies. Other columns are not read, and
    an empty table gives an empty result.
    """
    table, one = _removals(docs, window, grams, shard_bytes, id_col, text_col, False)
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content"))
    return table.select("doc_id", "content", "n_bytes", "sha").join(one, same, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    grams: tuple[int, int] = GRAMS,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, with the text that ``remove_repeats`` leaves.

    A character that loses some of its bytes goes as a whole. Null and empty texts stay
    as they are, rows equal in id and text lose the same strings, an empty table stays
    empty, and columns may have any names.
    """
    _, one = _removals(docs, window, grams, shard_bytes, id_col, text_col, True)
    # all columns travel under their number, so that none can clash with a name of this stage
    numbered = docs.select(
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
        F.col(id_col).alias("doc_id"), content_hash(text_col).alias("content"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content"))
    joined = numbered.join(one.select("own_id", "own_content", "kept"), same, "left")
    columns = [F.col(f"row.c{i}") for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    columns[at] = F.coalesce("kept", columns[at])
    return joined.select(*[column.alias(c) for column, c in zip(columns, docs.columns)])
