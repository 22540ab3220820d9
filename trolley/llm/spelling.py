"""Groups of spelling variants: words one letter apart, led to the commonest spelling.

The nodes of the trie of all words and of the trie of all reversed words are numbered.
A word without its i-th letter is then a pair of integers, the node of what stands before
and the node of what stands after; a word with a gap at a place is such a pair as well.
Equal pairs of letters left out are replacements, a letter left out that meets a gap is an
insertion or deletion. One grouping by pairs thus gives exact neighbours, and a pair holds
at most one word per letter of the alphabet, so no group grows with the data.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.prefix_trie import CRC_TABLE, crc_sql
from trolley.storage import written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_TIMES = 7, 2
# one run in so many loses a letter
SLIPS = 31
# a form is so many times as frequent as its variant
RATIO = 10
# distinct words that a task gathers before it hands them on
GATHERED = 200_000

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def slipped(doc_id: str, run: str) -> str:
    """The run as it is read: without one letter if the hash of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % SLIPS:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _gather(least: int):
    """Words of at least ``least`` letters with their frequency among the rows of a task, in parts."""
    # greedy runs from the left, so a match is never a part of a run
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                found = runs.findall(text.as_py().translate(_LOWER).decode())
                for run, n in Counter(found).items():
                    word = slipped(doc_id, run)
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) > GATHERED:
                    yield part()
                    counts.clear()
        if counts:
            yield part()

    return gather


def word_counts(
    docs: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_times: int = LEAST_TIMES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((id_col, "id"), (text_col, "text"))]
    gathered = docs.select(*columns).mapInArrow(_gather(least_letters), "word string, n bigint")
    return gathered.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words with their trie nodes, numbered from 1 inside the partition."""
    last, path, nodes, at = "", [], 0, 0
    for batch in batches:
        paths = []
        for word in batch.column("word").to_pylist():
            shared = _common(last, word)
            fresh = len(word) - shared
            path = path[:shared] + list(range(nodes + 1, nodes + fresh + 1))
            nodes += fresh
            last = word
            paths.append(path)
        rows = range(at, at + batch.num_rows)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(rows, pa.int64()), pa.array(paths, pa.list_(pa.int64()))],
            names=[*batch.schema.names, "at", "path"],
        )


def numbered_trie(words: DataFrame) -> DataFrame:
    """``words`` with ``rank``, the place in sorted order, and ``path``, the numbers of its trie nodes.

    ``path`` has one number per letter; the root is 0. Range partitions number their nodes
    on their own. A partition's first word shares nodes with the last word before it:
    from one row per partition, as wide as one word, follows which those are and by how
    much all other numbers move.
    """
    spark = words.sparkSession
    sorted_words = words.repartitionByRange("word").sortWithinPartitions("word")
    columns = ", ".join(f"{c} {t}" for c, t in words.dtypes)
    local = written(
        sorted_words.withColumn("part", F.spark_partition_id()).mapInArrow(
            _number, f"{columns}, part int, at bigint, path array<bigint>"
        ),
        "trie-words",
    )
    ends = local.groupBy("part").agg(
        F.min(F.struct("at", "word")).alias("first"),
        F.max(F.struct("at", "word", "path")).alias("last"),
        F.max(F.element_at("path", -1)).alias("nodes"),
    )
    moves, before, carried, nodes, rows = [], "", [], 0, 0
    for part in sorted(ends.collect(), key=lambda r: r["part"]):
        shared = _common(before, part["first"]["word"])
        shift = nodes - shared
        moves.append((part["part"], shared, carried[:shared], shift, rows))
        before = part["last"]["word"]
        carried = [carried[x - 1] if x <= shared else x + shift for x in part["last"]["path"]]
        nodes += part["nodes"] - shared
        rows += part["last"]["at"] + 1
    moved = spark.createDataFrame(moves, "part int, shared bigint, known array<bigint>, shift bigint, offset bigint")
    path = F.transform(
        "path", lambda x: F.when(x <= F.col("shared"), F.get("known", (x - 1).cast("int"))).otherwise(x + F.col("shift"))
    )
    return local.join(F.broadcast(moved), "part").select(
        *words.columns, (F.col("offset") + F.col("at")).alias("rank"), path.alias("path")
    )


def _pairs(words: DataFrame) -> DataFrame:
    """(before, after, minus_n, rank, kind): the words with a letter left out, or a gap.

    Kind 2 is a gap, kind 1 a letter left out that differs from the next one, kind 0 any
    other letter left out. Leaving out any letter of a run of equal ones is the same, so
    only kind 1 meets gaps.
    """
    root = F.array(F.lit(0).cast("bigint"))
    ahead, behind, size = F.concat(root, "path"), F.concat(root, "back"), F.size("path")
    rest = F.reverse(F.slice(behind, F.lit(1), size))
    same = F.transform(F.sequence(F.lit(1), size), lambda i: (F.get("letters", i - 1) != F.get("letters", i)))
    skipped = F.zip_with(
        F.arrays_zip(F.slice(ahead, F.lit(1), size).alias("p"), rest.alias("s")),
        same,
        lambda x, differs: F.struct(
            x["p"].alias("p"), x["s"].alias("s"), F.coalesce(differs, F.lit(True)).cast("int").cast("tinyint").alias("kind")
        ),
    )
    gaps = F.zip_with(
        ahead, F.reverse(behind),
        lambda p, s: F.struct(p.alias("p"), s.alias("s"), F.lit(2).cast("tinyint").alias("kind")),
    )
    return words.withColumn("letters", F.split("word", "")).select(
        "rank", (-F.col("n")).alias("minus_n"), F.explode(F.concat(skipped, gaps)).alias("e")
    ).select(F.col("e.p").alias("before"), F.col("e.s").alias("after"), "minus_n", "rank", F.col("e.kind").alias("kind"))


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(rank, n_near, best): each word's number of near words and the most frequent of them."""
    items = F.sort_array(F.collect_list(F.struct("minus_n", "rank", "kind")))
    groups = pairs.groupBy("before", "after").agg(items.alias("items")).where(F.size("items") > 1)

    def of(test) -> Column:
        return F.transform(F.filter("items", test), lambda x: F.struct(x["minus_n"].alias("minus_n"), x["rank"].alias("rank")))

    groups = groups.select(
        of(lambda x: x["kind"] < 2).alias("skips"), of(lambda x: x["kind"] == 1).alias("ends"),
        of(lambda x: x["kind"] == 2).alias("gaps"), F.explode("items").alias("own"),
    )
    first = F.get("skips", F.lit(0))
    other = F.when(first["rank"] == F.col("own.rank"), F.get("skips", F.lit(1))).otherwise(first)
    skips, ends, gaps = F.size("skips") - 1, F.size("ends"), F.size("gaps")
    kind = F.col("own.kind")
    number = F.when(kind == 2, ends).when(kind == 1, skips + gaps).otherwise(skips)
    best = F.when(kind == 2, F.get("ends", F.lit(0))).when(kind == 1, F.least(other, F.get("gaps", F.lit(0)))).otherwise(other)
    found = groups.select(F.col("own.rank").alias("rank"), number.cast("bigint").alias("number"), best.alias("best"))
    return found.where("number > 0").groupBy("rank").agg(F.sum("number").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(rank, root): the last word that forms lead to. Each step is tenfold, so rounds are few."""
    links = written(forms.select("rank", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = links.select(F.col("rank").alias("root"), F.col("root").alias("far"))
        links = written(
            links.join(far, "root", "left").select("rank", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if links.where("moved").isEmpty():
            return links.select("rank", "root")
        links = links.select("rank", "root")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words(word, n)``.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is
    the near word of largest n (ties: the smallest in code-point order) if that is at
    least ``ratio`` times the word's n, which must be over 1; the root is the last word
    that forms lead to, the word itself without form. Words of any length and alphabet are
    taken; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    words = words.select("word", F.col("n").cast("bigint").alias("n"))
    ahead = written(numbered_trie(words), "spelling-words")
    behind = numbered_trie(ahead.select(F.reverse("word").alias("word"), F.col("rank").alias("own")))
    both = ahead.join(behind.select(F.col("own").alias("rank"), F.col("path").alias("back")), "rank")
    near = written(_neighbours(_pairs(both)), "spelling-near")
    found = ahead.select("word", "n", "rank").join(near, "rank", "left")
    is_form = -F.col("best.minus_n") >= ratio * F.col("n")
    found = written(
        found.select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best.rank")).alias("form"), F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    led = found.where("form IS NOT NULL")
    names = found.select("rank", "word")
    forms = (
        led.join(_roots(led), "rank")
        .join(names.select(F.col("rank").alias("form"), F.col("word").alias("form_word")), "form")
        .join(names.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root")
        .select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    )
    rest = found.where("form IS NULL").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n"
    )
    return forms.unionByName(rest)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling groups of the words of ``docs``; see :func:`spelling_groups`.

    Words are runs of letters with A-Z lower-cased, of at least 7 code points and 2
    occurrences, after the slips of :func:`slipped`. A null text has no words, a null id
    is empty, repeated rows count again, other columns are not read.
    """
    return spelling_groups(written(word_counts(docs, id_col=id_col, text_col=text_col), "spelling-counts"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (
    SELECT id, run, count(*) AS k FROM (
        SELECT coalesce(doc_id::VARCHAR, '') AS id,
               unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[{LETTERS}]+')) AS run
        FROM documents
    ) WHERE length(run) >= {LEAST_LETTERS} GROUP BY id, run
),
hashed AS (SELECT run, k, {crc_sql("(id || ':' || run)")} AS h FROM runs, crc),
words AS (
    SELECT word, sum(k)::BIGINT AS n FROM (
        SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                    ELSE run END AS word, k FROM hashed
    ) WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_TIMES}
),
skips AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
),
shorter AS (SELECT DISTINCT s.word, s.rest FROM skips s JOIN words w ON w.word = s.rest),
near AS (
    SELECT a.word, b.word AS other FROM skips a JOIN skips b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT word, rest FROM shorter UNION ALL SELECT rest, word FROM shorter
),
best AS (
    SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near
    FROM near JOIN words w ON w.word = other
    QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) = 1
),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
           CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form,
           CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
),
led AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT led.word, f.form FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NOT NULL
),
last AS (SELECT led.word, led.root FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NULL)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n FROM formed f JOIN last ON last.word = f.word
"""
