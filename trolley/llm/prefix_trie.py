"""The prefix trie of conversations by digests of blocks of turns.

Conversations fall into blocks of a fixed number of turns. The digest of a prefix is the
XOR of the digests of its turns, each hashed with its place, so digests at block ends come
from one running XOR. Conversations are grouped by block ends first. Where all members of
a block's start go on with the same block, its inner nodes follow from the group; only
blocks where siblings diverge are refined turn by turn, and over distinct blocks, not over
conversations.

Sums over subtrees need no walk up the trie. A conversation owns the nodes whose smallest
member it is: a tail of its path. What a conversation adds to a node depends on where its
tail begins and whether it owns a leaf, so each sum is one grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.functions.hashing import hash_to_long
from trolley.operators.position import with_key_positions
from trolley.operators.skew import attach_by_key
from trolley.storage import written

BLOCK = 4
# blocks of one conversation that one window runs over
STRETCH = 1024
# members that are joined into one text
LISTED = 4096
FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation, numbered from 1.

    Null turns come first and equal turns go by their digest; a null role or text is
    empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.substring(F.sha2(whole, 256), 1, 32).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    order = ["turn", "digest"]
    # ascending order puts nulls first
    placed = with_key_positions(written(turns, "turns"), ["conv_id"], order, "pos", "turns")
    words = F.col("words").cast("bigint").alias("words")
    return written(placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "digest", words), "placed-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations rebuilt on the first turns of their family's head, and all their ids.

    Conversation c takes the first h turns of c - c % 20, as far as they exist, then its
    own turns after its first h; h = crc32(c) % 4. At most 39 conversations share a head.
    """
    heads = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS))
    first = first.groupBy(F.col("conv_id").alias("head")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("first")
    )
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")).select(
        "conv_id", "n_turns", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head")
    )
    ids = written(
        ids.join(first, "head", "left").select(
            "conv_id", "n_turns", "h", F.slice(F.coalesce("first", F.array()), 1, F.col("h")).alias("first")
        ),
        "conversations",
    )
    taken = ids.select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.*")
    # most heads are long enough, and only the others move what follows
    moved = ids.where(F.size("first") < F.col("h")).select(
        "conv_id", "n_turns", (F.col("h") - F.size("first")).alias("less")
    )
    own = attach_by_key(turns.where(F.col("pos") > heads), moved, ["conv_id"], "n_turns", how="left", cheap=True)
    own = own.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "digest", "words")
    return taken.unionByName(own), ids.select("conv_id")


def _block_rows(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: digests before and after it, its turns and words.

    ``a1, a2`` is the prefix digest before the block and ``z1, z2`` after it; ``turns``
    holds (digest of the prefix up to the turn, words up to it) relative to the block.
    """
    placed = F.sha2(F.concat_ws(":", "pos", "digest"), 256)
    items = F.struct(
        "pos", hash_to_long(placed).alias("e1"), hash_to_long(F.substring(placed, 16, 15)).alias("e2"), "words"
    )
    rows = (
        turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / block).cast("bigint").alias("block"))
        .agg(F.sort_array(F.collect_list(items)).alias("items"))
        .withColumn("stretch", F.floor(F.col("block") / STRETCH))
    )
    for e in ("e1", "e2"):
        folded = F.aggregate(F.col(f"items.{e}"), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x))
        rows = rows.withColumn(e, folded)
    total = F.aggregate("items.words", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    # running values inside a stretch of blocks, then over the few stretches of a conversation
    upto = W.partitionBy("conv_id", "stretch").orderBy("block")
    rows = rows.withColumn("w", total).withColumns(
        {"z1": F.bit_xor("e1").over(upto), "z2": F.bit_xor("e2").over(upto), "wz": F.sum("w").over(upto)}
    )
    rows = written(rows, "conversation-blocks")
    long = rows.where("stretch > 0").select("conv_id").distinct()
    whole = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "stretch").agg(
        F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"), F.sum("w").alias("sw")
    )
    before = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = whole.select(
        "conv_id", "stretch", F.bit_xor("s1").over(before).alias("c1"), F.bit_xor("s2").over(before).alias("c2"),
        F.sum("sw").over(before).alias("cw"),
    ).where("stretch > 0")
    none = F.lit(0).cast("bigint")
    rows = rows.join(carried, ["conv_id", "stretch"], "left")
    z1, z2 = (F.col(f"z{i}").bitwiseXOR(F.coalesce(f"c{i}", none)) for i in (1, 2))
    return rows.select(
        "conv_id",
        (F.col("block") * block).alias("start"),
        (F.col("block") * block + F.size("items")).alias("end"),
        z1.bitwiseXOR(F.col("e1")).alias("a1"),
        z2.bitwiseXOR(F.col("e2")).alias("a2"),
        z1.alias("z1"),
        z2.alias("z2"),
        (F.col("wz") + F.coalesce("cw", none) - F.col("w")).alias("before"),
        "items",
    )


def _turn_nodes(groups: DataFrame) -> DataFrame:
    """One row per group of equal blocks and turn in it, keyed by the prefix digest up to the turn."""
    each = groups.select(
        "*", F.explode(F.sequence(F.lit(1), F.size("items"))).alias("j")
    ).withColumn("upto", F.slice("items", 1, F.col("j")))

    def folded(e: str) -> Column:
        return F.aggregate(F.col(f"upto.{e}"), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x))

    item = F.element_at("items", F.col("j"))
    each = each.withColumns(
        {
            "depth": F.col("start") + F.col("j"),
            "x1": F.col("a1").bitwiseXOR(folded("e1")),
            "x2": F.col("a2").bitwiseXOR(folded("e2")),
            "w": item["words"],
            "inside": F.aggregate("upto.words", F.lit(0).cast("bigint"), lambda acc, x: acc + x) - item["words"],
        }
    )
    return each.withColumns(
        {"y1": F.col("x1").bitwiseXOR(item["e1"]), "y2": F.col("x2").bitwiseXOR(item["e2"])}
    )


def _per_node(groups: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """The trie nodes of ``groups`` with the number of members, the smallest and ``sums``.

    Blocks without siblings give their nodes at once; the others are grouped by prefix.
    """
    rows = _turn_nodes(groups)
    columns = {"n_convs": F.col("n"), "conv_id": F.col("least"), "seen": F.col("before") + F.col("inside"), **sums}
    key = ["depth", "x1", "x2", "y1", "y2"]
    rows = rows.select("diverges", *key, *[c.alias(name) for name, c in columns.items()])
    alone = rows.where("NOT diverges").drop("diverges")
    folds = {name: F.sum(name) for name in columns} | {"conv_id": F.min("conv_id"), "seen": F.first("seen")}
    refined = rows.where("diverges").groupBy(*key).agg(*[f.alias(name) for name, f in folds.items()])
    return alone.unionByName(refined)


def _listed(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): the digest of the sorted member ids that end in a node.

    Ids are joined in parts of 4,096; the parts of a node stream through one hash, so a
    node where a third of all conversations end holds one part in memory at a time.
    """
    key = ["depth", "x1", "x2"]
    placed = with_key_positions(ends, key, ["conv_id"], "at", "n_ends")
    parts = written(
        placed.groupBy(*key, F.floor(F.col("at") / LISTED).alias("part"), "n_ends").agg(
            F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
        ),
        "trie-ends",
    )
    short = parts.where(F.col("n_ends") <= LISTED).select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    long = parts.where(F.col("n_ends") > LISTED).select(*key, "part", "ids")
    streamed = long.repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(
        _stream, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string"
    )
    return short.unionByName(streamed)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its parts, which come in order."""
    names = ["depth", "x1", "x2", "ends_sha256"]
    node, state = None, None

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v], pa.int64()) for v in node], pa.array([state.hexdigest()])], names=names
        )

    for batch in batches:
        keys = zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)
        for key, ids in zip(keys, batch.column(4), strict=True):
            if key != node:
                if node is not None:
                    yield result()
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if node is not None:
        yield result()


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per trie node of all rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Rows without conv_id are
    left out; repeated rows are turns of their own; an empty table has no node, not even a
    root. Other columns are not read. Two prefixes are the same if 120 bits of SHA-256 of
    their placed turns agree.
    """
    turns, ids = rebuilt(turn_rows(conversations))
    blocks = written(_block_rows(turns, block), "trie-blocks")
    group, start = ["end", "z1", "z2"], ["start", "a1", "a2"]
    found = blocks.groupBy(*group, *start).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("before").alias("before"),
        F.first("items").alias("items"),
    )
    found = written(found, "trie-groups")
    siblings = found.groupBy(*start).agg(F.count("*").alias("siblings"))
    groups = written(
        attach_by_key(found, siblings, start, "siblings").withColumn("diverges", F.col("siblings") > 1).drop("siblings"),
        "trie-groups",
    )

    none = F.lit(0).cast("bigint")
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        none.alias("depth"), none.alias("x1"), none.alias("x2"), none.alias("y1"), none.alias("y2"),
        "n_convs", "conv_id", none.alias("seen"),
    )
    nodes = written(_per_node(groups, {}).unionByName(root), "trie-nodes")
    # children per prefix digest; a node of depth d is the parent of those of depth d + 1
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2")
    ).agg(F.count("*").alias("n_children"))
    nodes = written(
        nodes.join(children, ["depth", "x1", "x2"], "left").fillna(0, ["n_children"]), "trie-nodes"
    )
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("y1"), F.col("x2").alias("y2"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_siblings"),
    )

    # where the nodes that a conversation owns begin, the words before them, whether one is a leaf
    owned = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", "seen")).alias("top"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf")
    ).select("conv_id", F.col("top.seen").alias("shared"), "leaf")
    totals = blocks.groupBy("conv_id").agg(
        F.count("*").alias("n_blocks"),
        F.max(F.col("before") + F.aggregate("items.words", none, lambda acc, x: acc + x)).alias("words"),
    )
    facts = written(
        ids.join(totals, "conv_id", "left").join(owned, "conv_id", "left").select(
            "conv_id", F.coalesce("shared", "words", none).alias("shared"), F.coalesce("leaf", none).alias("leaf"),
            F.coalesce("n_blocks", none).alias("n_blocks"),
        ),
        "trie-conversations",
    )
    # words that a conversation shares from the block on; the smallest member's are kept apart
    shared = F.greatest(F.col("shared") - F.col("before"), none)
    members = attach_by_key(
        blocks.select("conv_id", *group, "before"), facts, ["conv_id"], "n_blocks", cheap=True
    ).groupBy(*group).agg(
        F.sum(shared).alias("shared"), F.sum("leaf").alias("leaves"), F.min(F.struct("conv_id", shared.alias("own"))).alias("own"),
    )
    summed = groups.join(members.withColumn("own", F.col("own.own")), group)
    saved = (
        F.col("shared") - F.col("own") - (F.col("n") - 1) * F.col("inside")
        + F.greatest(F.col("own") - F.col("inside"), none)
    )
    sums = _per_node(summed, {"n_leaves": F.col("leaves"), "saved_tokens": saved})
    top = facts.agg(F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens")).where("n_leaves IS NOT NULL").select(
        none.alias("depth"), none.alias("x1"), none.alias("x2"), "n_leaves", "saved_tokens"
    )
    key = ["depth", "x1", "x2"]
    sums = sums.select(*key, "n_leaves", "saved_tokens").unionByName(top)

    last = blocks.groupBy("conv_id").agg(F.max(F.struct("end", "z1", "z2")).alias("last"))
    ends = ids.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.end", none).alias("depth"), F.coalesce("last.z1", none).alias("x1"),
        F.coalesce("last.z2", none).alias("x2"),
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        attach_by_key(nodes, parents, ["depth", "y1", "y2"], "n_siblings", how="left", cheap=True)
        .join(sums, key)
        .join(_listed(ends), key, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


# the table of crc32 and its value for a text, as DuckDB states them
CRC_TABLE = """
    SELECT list_transform(range(256), lambda b: list_reduce(range(8),
        lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS t
"""


def crc_sql(text: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    each = f"list_transform(range(strlen({text})), lambda i: {byte})"
    return f"xor(list_reduce({each}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


ORACLE = f"""
WITH crc AS ({CRC_TABLE}),
placed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, digest, words
    FROM (
        SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words
        FROM conversations WHERE conv_id IS NOT NULL
    )
),
ids AS (SELECT DISTINCT conv_id FROM placed),
heads AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % {HEADS} AS h FROM ids, crc),
rebuilt AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, digest, words FROM (
        SELECT c.conv_id, 0 AS own, p.pos, p.digest, p.words
        FROM heads c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % {FAMILY} AND p.pos <= c.h
        UNION ALL
        SELECT c.conv_id, 1, p.pos, p.digest, p.words FROM heads c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h
    )
),
paths AS (
    SELECT conv_id, depth, words, string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids
),
nodes AS (
    SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words
    FROM paths GROUP BY depth, path
),
parents AS (
    SELECT v.depth, v.conv_id, p.conv_id AS parent_conv_id FROM nodes v
    JOIN paths m ON m.conv_id = v.conv_id AND m.depth = v.depth - 1 JOIN nodes p ON p.depth = m.depth AND p.path = m.path
),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM parents GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, conv_id)),
sums AS (
    SELECT a.depth, a.conv_id, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
    FROM counted v JOIN paths m ON m.conv_id = v.conv_id AND m.depth <= v.depth
    JOIN nodes a ON a.depth = m.depth AND a.path = m.path GROUP BY a.depth, a.conv_id
),
ends AS (
    SELECT depth, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members
    FROM (SELECT * FROM paths QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY depth, path
)
SELECT c.conv_id::BIGINT AS conv_id, c.depth::BIGINT AS depth, p.parent_conv_id::BIGINT AS parent_conv_id,
       c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
FROM counted c LEFT JOIN parents p USING (depth, conv_id) JOIN sums s USING (depth, conv_id)
LEFT JOIN ends e ON e.depth = c.depth AND e.path = c.path
"""
