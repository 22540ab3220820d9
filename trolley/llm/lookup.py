"""Fetching the whole texts of a few rows without moving the other texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# keys of 16 bytes; a key list up to this length goes to all executors, a longer one is joined
SENT_KEYS = 400_000


def content_hash(text_col: str) -> Column:
    """A 64-bit hash of the text; with the id it names the texts of a table."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``wanted(doc_id, content, ...)``, one per key, with the text of each.

    Rows of ``docs`` equal in id and text give the text once each. Texts that are not
    wanted stay where they are if the key list is small, and are shuffled otherwise.
    """
    texts = docs.select(
        F.col(id_col).alias("own_id"), content_hash(text_col).alias("own_content"), F.col(text_col).alias("text")
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_content") == F.col("content"))
    if wanted.count() <= SENT_KEYS:
        texts = texts.join(F.broadcast(wanted.select("doc_id", "content")), same, "left_semi")
    return texts.join(wanted, same).drop("own_id", "own_content")
