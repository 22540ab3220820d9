"""Token counts of whole texts without materialising ids.

A text falls into pre-tokens that no piece of the vocabulary crosses, so its tokens are
its pre-tokens' tokens. Each distinct pre-token is encoded once for the whole corpus; the
piece counts are then joined to the frequencies of pre-tokens in each document and summed.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.storage import written

LIMIT = 4096
# the most frequent pre-tokens, up to this many, go to all executors; the others are joined
SENT_TOKENS = 500_000
# a longer pre-token is known by its hash, so that what is sent has a size bound
KEY_BYTES = 32
# distinct pre-tokens that a task gathers before it hands them on
GATHERED = 200_000
ENCODED_AT_ONCE = 2_000

# spaces go with what follows them; line feeds stand alone
PRETOKEN = re.compile(r" +[^ \n]*|\n+|[^ \n]+")
_SPACE = "▁"

_known: tuple[str, dict[str, int]] = ("", {})


def pretokens(text: str | None) -> list[str]:
    """The pre-tokens of a text, the space that the model puts in front included."""
    if not text:
        return []
    return PRETOKEN.findall(" " + text.replace(_SPACE, " "))


def check_model(path: str) -> None:
    """Raise unless no piece can cross the border between two pre-tokens."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not model.is_byte(i) and (_SPACE in piece.lstrip(_SPACE) or "\n" in piece or " " in piece):
            raise ValueError(f"piece {piece!r} of {path} crosses pre-tokens")
    probe = " a  \n ﬁ\tÉ "
    if model.normalize(probe) != (" " + probe).replace(" ", _SPACE):
        raise ValueError(f"{path} changes texts before it splits them")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens with their frequency among the rows of a task, in parts."""
    counts: Counter[str] = Counter()

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pretoken", "n"]
        )

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(pretokens(text))
            if len(counts) > GATHERED:
                yield part()
                counts.clear()
    if counts:
        yield part()


def _pieces_of(path: str):
    """Per Arrow batch of distinct pre-tokens: the number of pieces of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            texts, pieces = batch.column("pretoken").to_pylist(), []
            for start in range(0, len(texts), ENCODED_AT_ONCE):
                # a line feed in front keeps the model's own space, a piece, off the pre-token
                ids = model.encode(["\n" + t for t in texts[start : start + ENCODED_AT_ONCE]], num_threads=1)
                pieces += [len(i) - 2 for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["pretoken", "n", "pieces"])

    return count


def piece_counts(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(key, n, pieces): each distinct pre-token of all texts, its frequency and its pieces.

    The key is the pre-token itself, or a hash of one longer than ``KEY_BYTES``.
    """
    check_model(model)
    gathered = docs.select(text_col).mapInArrow(_gather, "pretoken string, n bigint")
    distinct = gathered.groupBy("pretoken").agg(F.sum("n").alias("n"))
    counted = distinct.mapInArrow(_pieces_of(model), "pretoken string, n bigint, pieces bigint")
    long = F.concat(F.lit("#"), F.sha2("pretoken", 256))
    key = F.when(F.octet_length("pretoken") <= KEY_BYTES, F.col("pretoken")).otherwise(long)
    return written(counted.select(key.alias("key"), "n", "pieces"), "pretokens")


def _least_sent(counts: DataFrame, sent: int) -> int:
    """The least power of two such that at most ``sent`` pre-tokens are that frequent."""
    # one row per power of two
    sizes = {r["p"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("k")).collect()}
    power, total = max(sizes, default=0) + 1, 0
    while power > 0 and total + sizes.get(power - 1, 0) <= sent:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power


def _sums(shared, name: str):
    """Per Arrow batch of documents: the pieces of shared pre-tokens, and all other pre-tokens."""

    def keyed(token: str) -> str:
        import hashlib

        raw = token.encode()
        return token if len(raw) <= KEY_BYTES else "#" + hashlib.sha256(raw).hexdigest()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _known
        if _known[0] != name:
            keys, pieces = shared.value
            _known = (name, dict(zip(keys.to_pylist(), pieces.to_pylist(), strict=True)))
        pieces_of = _known[1]
        for batch in batches:
            known, keys, counts = [], [], []
            for text in batch.column(1).to_pylist():
                total, rest, rest_n = 0, [], []
                for token, n in Counter(pretokens(text)).items():
                    key = token if len(token) <= KEY_BYTES // 4 else keyed(token)
                    pieces = pieces_of.get(key)
                    if pieces is None:
                        rest.append(key)
                        rest_n.append(n)
                    else:
                        total += n * pieces
                known.append(total)
                keys.append(rest)
                counts.append(rest_n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(known, pa.int64()),
                    pa.array(keys, pa.list_(pa.string())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_bytes", "known", "keys", "counts"],
            )

    return add


def count_tokens(
    docs: DataFrame,
    model: str,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    sent: int = SENT_TOKENS,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): tokens of each whole text, one row per row.

    Tokens are those of the sentencepiece file ``model`` without begin and end; the file
    must be at the same path on every machine, and a file whose pieces cross pre-tokens is
    refused. A null or empty text has none. Repeated rows and null ids are rows like any
    other, an empty table gives none, other columns are not read. The ``sent`` most
    frequent pre-tokens reach the tasks by broadcast; each of the others is rare, so the
    join that adds their pieces has no hot key.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    counts = piece_counts(docs, model, text_col)
    least = _least_sent(counts, sent)
    local = counts.where(F.col("n") >= least).select("key", "pieces").toArrow()
    shared = spark.sparkContext.broadcast((local["key"].combine_chunks(), local["pieces"].combine_chunks()))
    columns = [
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"),
    ]
    summed = docs.select(*columns).mapInArrow(
        _sums(shared, uuid.uuid4().hex),
        f"doc_id {kind}, n_bytes bigint, known bigint, keys array<string>, counts array<bigint>",
    )
    summed = written(summed.withColumn("row", F.monotonically_increasing_id()), "token-sums")
    rare = summed.where(F.size("keys") > 0).select(
        "row", F.explode(F.arrays_zip("keys", "counts")).alias("e")
    ).select("row", F.col("e.keys").alias("key"), F.col("e.counts").alias("times"))
    found = (
        rare.join(counts.where(F.col("n") < least).select("key", "pieces"), "key")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    )
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    return (
        summed.drop("keys", "counts")
        .join(found, "row", "left")
        .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
    )
