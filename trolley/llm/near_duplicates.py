"""Joining documents by the Jaccard likeness of their word n-grams, with parity sketches.

A document's shingles are XORed into the slots of a sketch. The number of slots in
which two sketches differ cannot exceed the symmetric difference of the two sets, and a
link bounds that difference by the sizes. So within a band of sizes, sketches with more
slots than the largest difference allowed have equal slots in every linked pair: the
sketches are joined slot by slot (pigeonhole), and candidates are verified exactly. Equal
slots have equal hashes, so slots are joined one part of all hashes after another, and
less is on the disk at a time.

No group of documents with an equal slot is expanded into its pairs. Each group has a
hub, the member that shares most slots with others, and every member is compared with
the hub. What is left are pairs of members that these links have not brought into one
component, of which one is not linked to the hub. Seen from the hub, each member is the
set of shingles in which it differs from it, and two members can link only if these
differences overlap enough. Elements that many of a group's members have, as a sample of
it tells, come last, so joining on the first few elements, in one fixed order, leaves few
pairs, and loses none whatever the sample says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.llm.components import connected_components
from trolley.llm.lookup import content_hash, texts_of
from trolley.llm.spans import SMALL_SLICE, SPACED, Prefix, lower, mixed, signed, slices, words
from trolley.operators.skew import attach_by_key
from trolley.storage import outliving, passing, spread, written

_U = np.uint64
_STEP = _U(0xA24BAED4963EE407)
BAND_GROWTH = 1.6
# a document has fewer size bands to be looked for in
MOST_BANDS = 64
# the keys are joined part by part, each with the shuffle files of its part only
KEY_PARTS = 4
# pairs that one copy of a hub's set is compared in
HUB_PAIRS = 256
_KEYS = [f"keys_{part}" for part in range(KEY_PARTS)]
# members of a large group that tell which elements are common, and in how many of them
SAMPLED, OFTEN = 64, 3


@dataclass(frozen=True)
class Likeness:
    """Linked: ``den`` times the common shingles are at least ``num`` times all shingles."""

    words: int = 5
    num: int = 80
    den: int = 100

    def difference(self, sizes: int) -> int:
        """The largest symmetric difference of two linked sets of so many shingles together."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def largest_partner(self, size: int) -> int:
        return size * self.den // self.num

    def linked(self, common: int, sizes: int) -> bool:
        return self.den * common >= self.num * (sizes - common)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a slice."""
    data = lower(data)
    starts, ends, rows = words(data, offsets, SPACED)
    h = Prefix(data).of(starts, ends)
    n = max(len(h) - n_words + 1, 0)
    grams = np.zeros(n, np.uint64)
    for i in range(n_words):
        grams = grams * _STEP + h[i : i + n]
    grams = mixed(grams)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= n_words:
            yield np.unique(grams[a : b - n_words + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for x in h[a:b]:
                whole = whole * _STEP + x
            yield mixed(whole)
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Size bands and the number of slots that each needs."""

    def __init__(self, likeness: Likeness):
        self.likeness = likeness
        self.lows = [1]
        self.slots: list[int] = []
        self.spare: list[int] = []

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size:
            low = self.lows[-1]
            high = max(low + 1, int(low * BAND_GROWTH))  # sizes low to high - 1
            most = high - 1
            apart = most * (self.likeness.den - self.likeness.num) // self.likeness.num
            # empty slots are equal in many documents; with enough spare slots a linked
            # pair has an equal slot that is not empty, unless both have more empty ones
            spare = 0
            for _ in range(4 if apart else 0):
                spare = 1 + int(1.5 * (apart + 1 + spare) * np.exp(-low / (apart + 1 + spare)))
            self.slots.append(apart + 1 + spare)
            self.spare.append(spare)
            self.lows.append(high)

    def schemes(self, size: int) -> list[int]:
        """The band of ``size`` and those below whose documents may link with one of that size."""
        self._grow(size)
        band = int(np.searchsorted(self.lows, size, "right")) - 1
        found = [band]
        while band and self.likeness.largest_partner(self.lows[band] - 1) >= size:
            band -= 1
            found.append(band)
        return found

    def keys(self, shingles: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Per band: how many keys a linked document has in common, and a key per slot.

        A key hashes band, slot and parity. Linked documents differ in fewer slots than
        there are, by the spare ones and one more; empty ones may be among the equal.
        """
        out = []
        for band in self.schemes(len(shingles)) if len(shingles) else []:
            n = self.slots[band]
            slot = ((shingles >> _U(32)) * _U(n)) >> _U(32)
            # sorted hashes have sorted slots, so a slot is one run
            filled, firsts = np.unique(slot, return_index=True)
            parity = np.bitwise_xor.reduceat(mixed(shingles ^ _STEP), firsts)
            need = 1 + self.spare[band] - (n - len(filled))
            if need < 1:
                every = np.zeros(n, np.uint64)
                every[filled.astype(np.int64)] = parity
                filled, parity = np.arange(n, dtype=np.uint64), every
            salt = np.array([band], np.uint64) * _STEP
            out.append((max(need, 1), mixed(mixed(parity + filled) + salt)))
        return out


def sketch_table(docs: DataFrame, likeness: Likeness, id_col: str, text_col: str) -> DataFrame:
    """Per row: row, doc_id, content, n_shingles, two hashes of the set, and per band need and keys.

    The keys are in ``KEY_PARTS`` columns by their last bits, so that a part is read alone.
    """
    kind = dict(docs.dtypes)[id_col]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(likeness)
        for batch in batches:
            for first, data, offsets in slices(batch.column(2), SMALL_SLICE):
                sizes, sums, mixes, needs, keys, bounds = [], [], [], [], [], [0]
                for s in shingle_sets(data, offsets, likeness.words):
                    sizes.append(len(s))
                    sums.append(np.sum(mixed(s + _STEP), dtype=np.uint64))
                    mixes.append(np.bitwise_xor.reduce(mixed(s ^ (_STEP >> _U(3)))) if len(s) else _U(0))
                    found = bands.keys(s)
                    needs += [need for need, _ in found]
                    keys += [signed(k) for _, k in found]
                    bounds.append(len(keys))
                n = len(sizes)
                upto = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
                every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                rows, parts = pa.array(bounds, pa.int32()), []
                for part in range(KEY_PARTS):
                    mine = every % KEY_PARTS == part
                    ends = np.concatenate([[0], np.cumsum(mine)])[upto].astype(np.int32)
                    per_band = pa.ListArray.from_arrays(pa.array(ends), pa.array(every[mine]))
                    parts.append(pa.ListArray.from_arrays(rows, per_band))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(sizes, pa.int64()),
                        pa.array(signed(np.array(sums, np.uint64))),
                        pa.array(signed(np.array(mixes, np.uint64))),
                        pa.ListArray.from_arrays(rows, pa.array(needs, pa.int32())),
                        *parts,
                    ],
                    names=["doc_id", "content", "n_shingles", "set_sum", "set_mix", "needs", *_KEYS],
                )

    schema = f"doc_id {kind}, content bigint, n_shingles bigint, set_sum bigint, set_mix bigint, needs array<int>"
    schema += "".join(f", {c} array<array<bigint>>" for c in _KEYS)
    rows = docs.select(F.col(id_col).alias("doc_id"), content_hash(text_col).alias("content"), F.col(text_col))
    return written(
        rows.mapInArrow(sketch, schema).withColumn("row", F.monotonically_increasing_id()), "sketches"
    )


def _sets(docs: DataFrame, wanted: DataFrame, likeness: Likeness, id_col: str, text_col: str) -> DataFrame:
    """``(node, shingles)`` of the texts named by ``wanted(node, doc_id, content)``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(1), SMALL_SLICE):
                found = [signed(s) for s in shingle_sets(data, offsets, likeness.words)]
                upto = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(found)),
                        pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(found))),
                    ],
                    names=["node", "shingles"],
                )

    # repeated rows have the same text; one of each is read
    texts = texts_of(docs, wanted, id_col, text_col).groupBy("node").agg(F.first("text").alias("text"))
    return written(texts.select("node", "text").mapInArrow(build, "node bigint, shingles array<bigint>"), "shingle-sets")


def _ordered_difference(hub: np.ndarray, own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Shingles of one set only: those that the hub lacks first, the group's common ones last."""
    parts = [np.setdiff1d(own, hub, True), np.setdiff1d(hub, own, True)]
    often = [np.isin(part, common) for part in parts]
    return np.concatenate([p[~o] for p, o in zip(parts, often, strict=True)] + [p[o] for p, o in zip(parts, often, strict=True)])


def _compare(
    pairs: DataFrame, sets: DataFrame, likeness: Likeness, common: DataFrame | None = None, prefixes: bool = True
) -> DataFrame:
    """Exact likeness of ``pairs(hub, node)``.

    With ``common(hub, common)``, ``leading`` are the elements by which members of a hub's
    group can meet; without, and with ``prefixes`` off, it is the whole difference. A hub
    with many pairs is copied, and its pairs are dealt to the copies.
    """

    whole, gap = likeness.den + likeness.num, likeness.den - likeness.num
    ordered = common is not None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            mine, theirs = batch.column(2), batch.column(3)
            for i, (hub_node, node) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ):
                hub = mine[i].values.to_numpy().view(np.uint64)
                own = theirs[i].values.to_numpy().view(np.uint64)
                sizes = len(hub) + len(own)
                shared = len(np.intersect1d(hub, own, assume_unique=True))
                linked, leading, apart = likeness.linked(shared, sizes), None, sizes - 2 * shared
                if ordered:
                    if linked:
                        # a partner is not linked to the hub, so the overlap is over half of this
                        twice = apart * whole + (len(hub) - len(own)) * gap
                        least = twice // (2 * whole) + 1
                    else:
                        least = apart - likeness.difference(len(own) + likeness.largest_partner(len(own)))
                    often = batch.column(4)[i].values
                    often = np.zeros(0, np.uint64) if often is None else often.to_numpy().view(np.uint64)
                    leading = signed(_ordered_difference(hub, own, often)[: apart - max(least, 1) + 1])
                elif not prefixes:
                    leading = signed(np.setxor1d(hub, own, assume_unique=True))
                rows.append((hub_node, node, linked, len(own), apart, leading))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                names=["hub", "node", "linked", "size", "apart", "leading"],
            )

    with passing(pairs.sparkSession):
        copies = written(
            pairs.groupBy("hub").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / HUB_PAIRS).cast("int")),
            "hub-copies",
        )
        dealt = attach_by_key(pairs, copies, ["hub"], "n", cheap=True).select(
            "hub", "node", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy")
        )
        hubs = sets.withColumnsRenamed({"node": "hub", "shingles": "mine"}).join(copies, "hub")
        if ordered:
            hubs = hubs.join(common, "hub", "left")
        hubs = hubs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("n", "copies")
        both = dealt.join(sets.withColumnRenamed("shingles", "theirs"), "node").join(hubs, ["hub", "copy"])
        found = both.select("hub", "node", "mine", "theirs", *(["common"] if ordered else [])).mapInArrow(
            compare, "hub bigint, node bigint, linked boolean, size bigint, apart bigint, leading array<bigint>"
        )
        with outliving():
            return written(found, "compared")


def _common(stars: DataFrame, sets: DataFrame, likeness: Likeness) -> DataFrame:
    """(hub, common): elements by which many members of a large group differ from its hub.

    Told by a bounded sample of members, and used for an order only.
    """

    # at most SAMPLED differences a hub
    def often(group: pa.Table) -> pa.Table:
        elements, n = np.unique(group["leading"].combine_chunks().flatten().to_numpy(), return_counts=True)
        found = pa.array([elements[n >= OFTEN]], pa.list_(pa.int64()))
        return pa.table([group["hub"].slice(0, 1), found], names=["hub", "common"])

    with passing(stars.sparkSession):
        large = stars.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > SAMPLED)
        picked = attach_by_key(stars, large, ["hub"], "n").withColumn(
            "no", F.row_number().over(W.partitionBy("hub").orderBy(F.xxhash64("node"), "node"))
        ).where(F.col("no") <= SAMPLED)
        unlike = _compare(picked.select("hub", "node"), sets, likeness, prefixes=False)
        found = unlike.select("hub", "leading").groupBy("hub").applyInArrow(often, "hub bigint, common array<bigint>")
        with outliving():
            return written(found, "common-elements")


def _members(sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, members): the members of each group of documents with an equal slot."""
    nodes = nodes.select(F.col("node").alias("row"))
    owner = F.col("row") * MOST_BANDS + F.col("band")
    parts = []
    for keys in _KEYS:
        own = sketches.select("row", keys).join(nodes, "row", "left_semi")
        # all slots move once: the count and the join that drops keys with one member share it
        slots = spread(
            own.select("row", F.posexplode(keys).alias("band", "of")).select(
                owner.alias("owner"), F.explode("of").alias("key")
            ),
            "key",
        )
        met = slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        parts.append(written(slots.join(met, "key"), "met-members"))
    member = reduce(DataFrame.unionByName, parts)
    # nor can a document with fewer shared keys than a link needs say anything
    needs = sketches.select("row", "needs").join(nodes, "row", "left_semi")
    needs = needs.select("row", F.posexplode("needs").alias("band", "need")).select(owner.alias("owner"), "need")
    able = member.groupBy("owner").agg(F.count("*").alias("n")).join(needs, "owner").where("n >= need").select("owner")
    able = written(able, "able-owners")
    member = member.join(able, "owner").select("key", F.expr(f"owner div {MOST_BANDS}").alias("node"))
    shared = member.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return written(attach_by_key(member, shared, ["key"], "members"), "slot-members")


def _stars(sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hub, node): each member of a group of documents with an equal slot, and the group's hub."""
    with passing(sketches.sparkSession):
        member = _members(sketches, nodes)
        # the hub of a group is the member with the largest groups, so that one compares most
        weight = member.groupBy("node").agg(F.sum("members").alias("weight"))
        hubs = member.join(weight, "node").groupBy("key", "members").agg(
            F.max(F.struct("weight", -F.col("node"))).alias("top"),
        ).select("key", "members", (-F.col("top.col2")).alias("hub"))
        stars = attach_by_key(member.drop("members"), hubs, ["key"], "members")
        with outliving():
            return written(stars.where("hub != node").select("hub", "node").distinct(), "stars")


def _contracted(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``(node, root)`` after the links ``found(hub, node)`` join components; outlives one block."""
    def root_of(col: str, name: str) -> DataFrame:
        return roots.select(F.col("node").alias(col), F.col("root").alias(name))

    edges = found.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    edges = edges.join(root_of("a", "ra"), "a", "left").join(root_of("b", "rb"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
    )
    merged = connected_components(edges.distinct())
    lone = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    every = roots.unionByName(lone.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    lifted = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
    with outliving():
        return written(every.join(lifted, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def joined_roots(
    docs: DataFrame, sketches: DataFrame, stars: DataFrame, likeness: Likeness, id_col: str, text_col: str
) -> DataFrame:
    """``(node, root)`` of the nodes that may have links: the components of all links.

    ``sketches`` name the rows, ``stars(hub, node)`` the members of groups.
    """
    with passing(docs.sparkSession):
        wanted = stars.select("node").union(stars.select("hub")).distinct()
        named = sketches.select(F.col("row").alias("node"), "doc_id", "content").join(wanted, "node", "left_semi")
        sets = _sets(docs, written(named, "set-names"), likeness, id_col, text_col)
        compared = _compare(stars, sets, likeness, _common(stars, sets, likeness))
        roots = connected_components(
            compared.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        )
        rest = _rest(compared, roots, likeness)
        return _contracted(roots, _compare(rest, sets, likeness).where("linked"))


def _rest(compared: DataFrame, roots: DataFrame, likeness: Likeness) -> DataFrame:
    """Pairs of members of one hub's group that can link and are not in one component.

    Of such a pair one member is not linked to the hub.
    """
    rooted = compared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    elements = rooted.join(mixed.select("hub"), "hub", "left_semi").select(
        "hub", "node", "root", "linked", "size", "apart", F.posexplode("leading").alias("at", "element")
    )
    a, b = elements.alias("a"), elements.where("NOT linked").alias("b")
    most = F.floor(
        (F.col("a.size") + F.col("b.size")) * (likeness.den - likeness.num) / (likeness.den + likeness.num)
    )
    # elements before the first common one are not common, so what follows bounds the overlap
    after = F.least(F.col("a.apart") - F.col("a.at"), F.col("b.apart") - F.col("b.at"))
    can = (
        (F.col("a.hub") == F.col("b.hub"))
        & (F.col("a.element") == F.col("b.element"))
        & (F.col("a.root") != F.col("b.root"))
        & (F.col("a.linked") | (F.col("a.node") < F.col("b.node")))
        & (F.col("a.apart") + F.col("b.apart") - 2 * after <= most)
        & (F.col("a.size") * likeness.den >= F.col("b.size") * likeness.num)
        & (F.col("b.size") * likeness.den >= F.col("a.size") * likeness.num)
    )
    pairs = a.join(b, can).select(F.col("a.node").alias("hub"), F.col("b.node").alias("node"))
    return written(pairs.distinct(), "rest-pairs")


def classes(
    docs: DataFrame, likeness: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, content, n_shingles, component_id and ``keep``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text with
    fewer words than a shingle has its whole word sequence as its only shingle; null,
    empty and blank texts have none and link with nothing. ``component_id`` is the
    smallest id reachable over links, a row's own included; null ids count only where a
    component has no other. ``keep`` marks one row per component, that of the smallest
    id; of rows that are equal in id and text the first read is kept. Repeated rows are
    linked like any other equal texts; other columns are not read; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    keys = ["n_shingles", "set_sum", "set_mix"]
    with passing(spark):
        # the keys are most of the sketches, and nothing reads them after the stars
        with passing(spark):
            keyed = sketch_table(docs, likeness, id_col, text_col)
            with outliving(2):
                sketches = written(keyed.select("row", "doc_id", "content", *keys), "sketched-rows")
            with outliving():
                sets = written(
                    sketches.where("n_shingles > 0")
                    .groupBy(*keys)
                    .agg(
                        F.min("row").alias("node"),
                        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"),
                        F.count("*").alias("copies"),
                    ),
                    "shingle-classes",
                )
                stars = _stars(keyed, sets)
        roots = joined_roots(docs, sketches, stars, likeness, id_col, text_col)
        rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = rooted.groupBy("root").agg(F.min("least").alias("first"))
        known = rooted.join(least, "root").select(*keys, "copies", "first")
        own = sketches.select("row", "doc_id", "content", *keys)
        with outliving():
            joined = attach_by_key(own, known, keys, "copies", "left")
    return joined.select(
        "doc_id",
        "content",
        "n_shingles",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("keep"),
    )


def keep_one(
    docs: DataFrame, likeness: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component, all columns.

    Rows without words stay, all of them.
    """
    with passing(docs.sparkSession):
        found = classes(docs, likeness, id_col, text_col)
        kept = (
            found.groupBy("doc_id", "content")
            .agg(F.max("keep").alias("keep"), F.count("*").alias("rows"), F.max("n_shingles").alias("n_shingles"))
            .where("keep")
            .select("doc_id", "content", ((F.col("rows") > 1) & (F.col("n_shingles") > 0)).alias("repeated"))
        )
        with outliving():
            kept = written(kept, "kept")
    # all columns travel under their number, so that none can clash with a name of this stage
    numbered = docs.select(
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("own"),
        F.col(id_col).alias("own_id"), content_hash(text_col).alias("own_content"),
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_content") == F.col("content"))
    columns = [F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    once = numbered.join(kept.where("NOT repeated"), same).select(*columns)
    if kept.where("repeated").isEmpty():
        return once
    # rows equal in id and text are one document; there is nothing to tell them apart by
    again = numbered.join(kept.where("repeated"), same).groupBy("own_id", "own_content")
    return once.unionByName(again.agg(F.first("own").alias("own")).select(*columns))
