"""License scans by diagonal voting.

Every k-gram of words of a text is joined to the places of license templates that have
the same words. A text place minus a template place is a diagonal; places on one
diagonal vote for the template standing there. Neighbouring diagonals, as an added or
missing word makes them, are merged, and spans that got votes are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.lookup import content_hash, texts_of
from trolley.llm.spans import ALNUM, Prefix, lower, mixed, signed, slices, words
from trolley.storage import written

GRAM_WORDS = 3
# diagonals so many words apart belong to one span
NEIGHBOURS = 6
# share of a template's words that a span needs
COVERAGE = 0.8

# fixed values: phrases that must stand word by word, and their labels
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# fixed values: wordings of public licenses that may be changed a little
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: list[str]
    exact: bool


def split_words(text: str) -> list[str]:
    """Runs of ASCII letters, digits and all that is not ASCII, A-Z lower-cased."""
    data = lower(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b].decode(errors="replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def default_templates() -> list[Template]:
    return [Template(label, split_words(phrase), True) for phrase, label in PHRASES.items()] + [
        Template(label, split_words(text), False) for label, text in TEMPLATES
    ]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = words(data, offsets, ALNUM)
    return Prefix(data).of(starts, ends), rows


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xA24BAED4963EE407) + hashes[i : i + n]
    return mixed(out)


def votes(docs: DataFrame, templates: list[Template], k: int, id_col: str, text_col: str) -> DataFrame:
    """Per text with any votes: ``(doc_id, content, spans)``, a span being template, diagonal, first, last, n."""
    kind = dict(docs.dtypes)[id_col]

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(2)):
                hashes, rows = _word_hashes(lower(data), offsets)
                grams = signed(_grams(hashes, k))
                # the last words of a text start no k-gram of their own
                ends = np.maximum(rows[1:] - k + 1, rows[:-1])
                lengths = ends - rows[:-1]
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                at = np.arange(bounds[-1]) + np.repeat(rows[:-1] - bounds[:-1], lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(lengths)),
                        batch.column(1).slice(first, len(lengths)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams[at])),
                    ],
                    names=["doc_id", "content", "grams"],
                )

    places = []
    for number, t in enumerate(templates):
        data = np.frombuffer(" ".join(t.words).encode(), np.uint8)
        hashes, _ = _word_hashes(data, np.array([0, len(data)]))
        places += [(int(g), number, at) for at, g in enumerate(signed(_grams(hashes, k)).tolist())]
    # the templates are given with the call: a few hundred places, sent to every task
    known = docs.sparkSession.createDataFrame(places, "gram bigint, template int, place int")
    rows = docs.select(F.col(id_col).alias("doc_id"), content_hash(text_col).alias("content"), F.col(text_col))
    rolled = rows.mapInArrow(roll, f"doc_id {kind}, content bigint, grams array<bigint>").select(
        "doc_id", "content", F.posexplode("grams").alias("at", "gram")
    )
    diagonals = (
        rolled.join(F.broadcast(known), "gram")
        .withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy("doc_id", "content", "template", "diagonal")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    )
    # the spans of one text, no more than its words times the templates
    return written(
        diagonals.groupBy("doc_id", "content").agg(
            F.sort_array(F.collect_list(F.struct("template", "diagonal", "first", "last", "n"))).alias("spans")
        ),
        "license-votes",
    )


def _merged(diagonals: list[tuple[int, int, int]], length: int) -> Iterator[list[int]]:
    """Groups of neighbouring diagonals whose votes lie within one template's length."""
    group: list[int] = []
    low = high = 0
    for diagonal, first, last in diagonals:
        if group and (diagonal - group[-1] > NEIGHBOURS or first > high + length or last < low - length):
            yield group
            group = []
        low, high = (min(low, first), max(high, last)) if group else (first, last)
        group.append(diagonal)
    if group:
        yield group


def verify(text: list[str], template: Template, diagonals: list[tuple[int, int, int]], coverage: float) -> list[tuple[int, int, float]]:
    """Spans ``(first word, last word, share of the template's words)`` that stand the test."""
    found, n = [], len(template.words)
    if template.exact:
        return [(d, d + n - 1, 1.0) for d, _, _ in diagonals if d >= 0 and text[d : d + n] == template.words]
    for group in _merged(diagonals, n):
        met: dict[int, int] = {}
        for d in group:
            for place in range(max(0, -d), min(n, len(text) - d)):
                if text[d + place] == template.words[place]:
                    met.setdefault(place, d + place)
        if len(met) >= coverage * n:
            found.append((min(met.values()), max(met.values()), len(met) / n))
    return found


def scan(
    docs: DataFrame,
    templates: list[Template] | None = None,
    k: int = GRAM_WORDS,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places of exact templates, ``first_word`` and ``last_word`` are
    the smallest and largest of their starts (null without any). ``labels`` adds those of
    verified spans, ``score`` is the best share of a template's words that a verified
    span has. ``spans`` holds all verified spans as label, first and last word and share.
    A template shorter than ``k`` words is never met. Null and empty texts have no words;
    repeated rows get equal results; other columns are not read.
    """
    templates = default_templates() if templates is None else templates
    kind = dict(docs.dtypes)[id_col]
    voted = votes(docs, templates, k, id_col, text_col)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own, by_template = split_words(text or ""), {}
                for s in spans:
                    by_template.setdefault(s["template"], []).append((s["diagonal"], s["first"], s["last"]))
                found = [
                    (templates[t], span)
                    for t, diagonals in by_template.items()
                    for span in verify(own, templates[t], diagonals, coverage)
                ]
                base = [span[0] for t, span in found if t.exact]
                rows.append(
                    {
                        "n_base": len(base),
                        "first_word": min(base, default=None),
                        "last_word": max(base, default=None),
                        "base_labels": ",".join(sorted({t.label for t, _ in found if t.exact})),
                        "labels": ",".join(sorted({t.label for t, _ in found})),
                        "score": max((span[2] for _, span in found), default=0.0),
                        "spans": [{"label": t.label, "first": a, "last": b, "share": c} for t, (a, b, c) in found],
                    }
                )
            kinds = {
                "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
                "labels": pa.string(), "score": pa.float64(),
                "spans": pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])),
            }
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([r[c] for r in rows], t) for c, t in kinds.items()]],
                names=["doc_id", "content", *kinds],
            )

    span = "array<struct<label: string, first: bigint, last: bigint, share: double>>"
    schema = (
        f"doc_id {kind}, content bigint, n_base bigint, first_word bigint, last_word bigint, "
        f"base_labels string, labels string, score double, spans {span}"
    )
    checked = texts_of(docs, voted, id_col, text_col).select("doc_id", "content", "spans", "text").mapInArrow(check, schema)
    one = checked.dropDuplicates(["doc_id", "content"]).withColumnsRenamed({"doc_id": "own_id", "content": "own_content"})
    count = F.regexp_count(F.col(text_col), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        content_hash(text_col).alias("content"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("n_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content"))
    return rows.join(one, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast(span)).alias("spans"),
    )
