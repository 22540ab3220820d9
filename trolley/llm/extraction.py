"""Main text of web pages by deducing the template of each host and page type.

Tokens are tags with their paths and text runs with theirs. Over the pages of a host,
and of each of its page types, the counts of a token are its occurrence vector, and
tokens with equal vectors form an equivalence class. A class is valid if it is large and
frequent enough and its tags nest: the tags that occur once on each page are the skeleton
of the template, text runs that occur on most pages are its constant text. What lies
between is slots. The article is the slot text of the skeleton's innermost container
that holds (nearly) all slot text that is no menu, header, footer, sidebar, advert,
notice, form or comment.

Pages of a host are of one type if they have the same kinds of containers. Occurrence
vectors are never gathered: a 64-bit hash of each is folded page by page.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.html import CONTAINERS, Run, blocks, read, settle
from trolley.operators.skew import attach_by_key
from trolley.storage import written

# share of a host's pages that a template token is on
SUPPORT = 0.9
# tokens that a class needs to be a template's
CLASS_SIZE = 3
# share of the slot text that the article's container holds
HELD = 0.9
# constant text needs so many different pages to be told from an article, a page type as many to be told from its host
CONSTANT_PAGES = 4
# from so many on, a constant paragraph in an article's flow is template text, below only a constant box is
FLOW_PAGES = 20
# tags and first classes whose set is a page's type
KINDS = r"(?i)<((?:article|main|section|div)\b(?:[^<>]*?\bclass\s*=\s*[\"']?[\w-]+)?)"
KIND_GAP = r"(?i)\s[^<>]*?\bclass\s*=\s*[\"']?"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_ROOT = _number("tag", "")


def _text_token(run: Run) -> int:
    return _number("text", run.node.path, " ".join(run.text.split()))


def _slots(runs: list[Run], constant: set[int]) -> list[Run]:
    """The runs that are no constant text; all of them if there is nothing else."""
    if not constant:
        return runs
    kept = [r for r in runs if not r.text.strip() or _text_token(r) not in constant]
    return kept if any(r.text.strip() and not r.node.outside for r in kept) else runs


def page_tokens(pages: DataFrame) -> DataFrame:
    """Per page and token: host, type, page, token, whether it is text, and count."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                where, tokens, text, counts = [], [], [], []
                for row, page in enumerate(part.column(3).to_pylist()):
                    nodes, runs = read(page or "")
                    tags = Counter(n.path for n in nodes)
                    texts = Counter(_text_token(r) for r in runs if r.text.strip())
                    tokens += [_number("tag", path) for path in tags]
                    tokens += texts
                    counts += tags.values()
                    counts += texts.values()
                    text += [False] * len(tags) + [True] * len(texts)
                    where += [row] * (len(tags) + len(texts))
                take = pa.array(where, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i).take(take) for i in range(3)],
                        pa.array(tokens, pa.int64()),
                        pa.array(text, pa.bool_()),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["host", "type", "page", "token", "text", "n"],
                )

    return pages.select("host", "type", "page", "html").mapInArrow(
        build, "host string, type bigint, page bigint, token bigint, text boolean, n bigint"
    )


def held_chars(pages: DataFrame) -> DataFrame:
    """Per host, type and container: its token, path and slot characters, all pages together."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                where, tokens, paths, chars, sets = [], [], [], [], {}
                for row, (page, constant) in enumerate(zip(part.column(2).to_pylist(), part.column(3), strict=True)):
                    nodes, runs = read(page or "")
                    settle(nodes, _slots(runs, _constant(constant, sets)))
                    for node in {n.path: n for n in nodes[1:] if n.tag in CONTAINERS and not n.outside}.values():
                        where.append(row)
                        tokens.append(_number("tag", node.path))
                        paths.append(node.path)
                        chars.append(node.chars)
                take = pa.array(where, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i).take(take) for i in range(2)],
                        pa.array(tokens, pa.int64()),
                        pa.array(paths, pa.string()),
                        pa.array(chars, pa.int64()),
                    ],
                    names=["host", "type", "token", "path", "chars"],
                )

    held = pages.select("host", "type", "html", "constant").mapInArrow(
        build, "host string, type bigint, token bigint, path string, chars bigint"
    )
    return held.groupBy("host", "type", "token", "path").agg(F.sum("chars").alias("chars"))


def _constant(tokens: pa.Scalar, sets: dict[tuple, set[int]]) -> set[int]:
    """The set of a list of tokens, made once for pages with equal lists."""
    key = tuple(tokens.values.to_pylist()) if tokens.is_valid else ()
    return sets.setdefault(key, set(key))


_LEVEL = ["host", "whole", "type"]


def _levels(by_type: DataFrame, *keys: str, **sums: str) -> DataFrame:
    """Rows of page types, and of whole hosts (type 0) summed up from them."""
    hosts = by_type.groupBy("host", *keys).agg(*[F.expr(f"{how}({c})").alias(c) for c, how in sums.items()])
    hosts = hosts.select("host", F.lit(True).alias("whole"), F.lit(0).cast("bigint").alias("type"), *keys, *sums)
    return by_type.select("host", F.lit(False).alias("whole"), "type", *keys, *sums).unionByName(hosts)


def templates(pages: DataFrame) -> DataFrame:
    """Per host and page type: pages, the container's path (null if there is none) and constant text tokens.

    A type with too few pages has its host's template; other types have what is constant
    on the whole host besides their own constant text.
    """
    # copies of a page say nothing about its template
    once = page_tokens(pages).dropDuplicates(["host", "type", "page", "token"])
    # the occurrence vector of a token, folded: one hash per page it is on and how often
    vectors = written(
        once.groupBy("host", "type", "token", "text").agg(
            F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("on"), F.max("n").alias("most")
        ),
        "token-vectors",
    )
    levels = _levels(vectors, "token", "text", vector="bit_xor", on="sum", most="max")
    sizes = written(
        levels.where((F.col("token") == _ROOT) & ~F.col("text")).select(*_LEVEL, F.col("on").alias("differing")), "template-sizes"
    )
    trusted = sizes.where(F.col("whole") | (F.col("differing") >= CONSTANT_PAGES))
    frequent = written(
        levels.where(((F.col("on") > 1) | ~F.col("text")) & (F.col("token") != _ROOT))
        .join(trusted, _LEVEL)
        .where(F.col("on") >= SUPPORT * F.col("differing")),
        "template-tokens",
    )
    classes = frequent.groupBy(*_LEVEL, "vector").agg(F.count("*").alias("members")).where(F.col("members") >= CLASS_SIZE)
    skeleton = frequent.join(classes, [*_LEVEL, "vector"], "left_semi").where("most = 1 AND NOT text")
    constant = frequent.where((F.col("differing") >= CONSTANT_PAGES) & F.col("text"))
    sure = F.when(F.col("differing") >= FLOW_PAGES, F.col("token"))
    on_host = constant.where("whole").groupBy("host").agg(
        F.collect_set("token").alias("on_host"), F.collect_set(sure).alias("sure_on_host")
    )
    on_type = constant.where("NOT whole").groupBy("host", "type").agg(
        F.collect_set("token").alias("on_type"), F.collect_set(sure).alias("sure_on_type")
    )
    none = F.array().cast("array<bigint>")
    # all rows of a type count here, copies too: what is sent to whom depends on it
    known = written(
        pages.groupBy("host", "type")
        .agg(F.count("*").alias("pages"))
        .join(on_host, "host", "left")
        .join(on_type, ["host", "type"], "left")
        .select(
            "host", "type", "pages",
            F.array_sort(F.array_union(F.coalesce("on_host", none), F.coalesce("on_type", none))).alias("constant"),
            F.array_sort(F.array_union(F.coalesce("sure_on_host", none), F.coalesce("sure_on_type", none))).alias("sure"),
        ),
        "constant-text",
    )
    held = written(held_chars(attach_by_key(pages, known, ["host", "type"], "pages", "left", cheap=True)), "held-chars")
    # nesting: of the once-a-page containers the innermost that still holds the slot text
    weighed = skeleton.join(_levels(held, "token", "path", chars="sum"), [*_LEVEL, "token"])
    full = weighed.groupBy(*_LEVEL).agg(F.max("chars").alias("all"))
    named = F.when(F.element_at(F.split("path", "/"), -1).rlike(r"^(article|main)(\.|$)"), 1).otherwise(0)
    depth = F.size(F.split("path", "/"))
    container = (
        weighed.join(full, _LEVEL)
        .where(F.col("chars") >= HELD * F.col("all"))
        .groupBy(*_LEVEL)
        .agg(F.max_by("path", F.struct(named, F.when(named == 1, -depth).otherwise(depth), "path")).alias("container"))
    )
    of_host = container.where("whole").select("host", F.col("container").alias("of_host"))
    of_type = container.where("NOT whole").select("host", "type", F.col("container").alias("of_type"))
    return known.join(of_host, "host", "left").join(of_type, ["host", "type"], "left").select(
        "host", "type", "pages", F.coalesce("of_type", "of_host").alias("container"), "constant", "sure"
    )


def article(page: str, container: str | None, constant: set[int], sure: set[int]) -> str:
    """The text of a page's article given its host's template.

    Constant text goes where no container is found, where it is ``sure``, and in boxes
    that hold nothing else.
    """
    nodes, runs = read(page)
    slots = _slots(runs, constant)
    settle(nodes, slots)
    inside = {n.number for n in nodes if container is not None and n.path == container and not n.outside}
    if not inside:
        named = [n for n in nodes if n.tag in ("article", "main") and not n.outside]
        inside = {n.number for n in named[:1]}
    boxes = {n.number for n in nodes if n.tag in CONTAINERS and not n.chars}

    def kept(runs: list[Run]) -> str:
        own = (
            r
            for r in runs
            if not r.node.outside and (not inside or r.node.number in inside or not inside.isdisjoint(r.node.parents))
        )
        return "\n\n".join(blocks(own))

    if not inside or slots is runs:
        return kept(slots)
    flow = [r for r in _slots(runs, sure) if r.node.number not in boxes and boxes.isdisjoint(r.node.parents)]
    # an article without slots is its constant text
    return kept(flow) or kept(runs)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by empty lines) and n_chars.

    Pages without a host (null or odd urls) share one template. A host with a single page
    has the page's own skeleton for a template. Copies of a page count once for the
    template. Boxes of text that is constant over four pages or more are left out, and
    constant paragraphs from 20 pages on, unless an article has nothing else. Null and empty pages have an empty text;
    broken markup is read as far as it goes; character references are decoded. Repeated
    rows get equal texts; other columns are not read; an empty table gives an empty
    result. A host may hold any share of the pages: its tokens are counted before they
    are shuffled, and its template is sent to its pages where they are.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"),
        F.col(html_col).alias("html"),
    )
    kinds = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(KINDS), 1), lambda k: F.lower(F.regexp_replace(k, KIND_GAP, ".")))
    rows = rows.withColumn("type", F.xxhash64(F.array_sort(F.array_distinct(kinds))))
    known = templates(rows.withColumn("page", F.xxhash64(F.coalesce("html", F.lit("")))))
    kind = dict(pages.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts, sets = [], {}
                for page, container, constant, sure in zip(
                    part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), part.column(5), strict=True
                ):
                    texts.append(article(page or "", container, _constant(constant, sets), _constant(sure, sets)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(texts, pa.string()),
                        pa.array(np.array([len(t) for t in texts], np.int64)),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    told = attach_by_key(rows, known, ["host", "type"], "pages", "left")
    return told.select("page_id", "url", "html", "container", "constant", "sure").mapInArrow(
        cut, f"page_id {kind}, url string, text string, n_chars bigint"
    )
