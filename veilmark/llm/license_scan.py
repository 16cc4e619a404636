"""License labels of documents: exact phrases, and an exact containment join with license templates.

A template is looked for in windows of the text, whatever its lines: a template of up to ``w`` words,
``w`` a power of two, in windows of ``2 w`` words that begin every ``w`` words.  So any stretch of
``w`` words lies within a window, and words that are further apart never make up a notice.  A template
is found in a window whose word set holds at least ``threshold`` of the template's word set; short
templates, of fewer than ``WHOLE`` words, must be there whole, since one word may be all that tells
them from ordinary text.  Words are put in one global order, the rarest in the corpus first.  A window
that reaches the needed overlap must share one of the template's first ``size - need + 1`` words
(prefix filter), have at least ``need`` template words (length filter), and leave room for the rest
behind the shared word (positional filter).  What passes is verified on the full sets, so no window is
lost or found wrongly.

Only words of some template can add to an overlap, so windows are reduced to those words.
Templates are a parameter and their number is bounded (``MAX_TEMPLATES``): their prefix index
is what is broadcast.  Counts come from all documents.

Defined cases: a null text has no words; ids may be null or repeat; empty table, empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cut

#: Phrases and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices commonly put into works, by SPDX-like label.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"
    ),
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

THRESHOLD = 0.8
#: Templates of fewer different words are found as a whole only.
WHOLE = 10
LEAST_WIDTH = 8
MAX_TEMPLATES = 10_000

# Separators 00-2F, 3A-40, 5B-60, 7B-7F become spaces and A-Z are lowered; other bytes stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def license_words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    need: int
    width: int


def prepare(templates: dict[str, str], threshold: float, whole: int = WHOLE) -> list[Template]:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    made = []
    for label, text in sorted(templates.items()):
        ordered = license_words(text.encode())
        ws = sorted({w.decode("utf-8") for w in ordered})
        if ws:
            need = len(ws) if len(ws) < whole else max(1, math.ceil(threshold * len(ws) - 1e-9))
            made.append(Template(label, tuple(ws), need, max(LEAST_WIDTH, 1 << (len(ordered) - 1).bit_length())))
    return made


def windows(known: list[tuple[int, int]], width: int) -> Iterator[tuple[int, list[int]]]:
    """``(first word, sorted template words)`` of windows of ``2 * width`` words.

    *known* are the places and numbers of the template words of a text.  Windows without one, and
    those that hold no more than the window before, are left out.
    """
    cells: dict[int, set[int]] = {}
    for at, word in known:
        cells.setdefault(at // width, set()).add(word)
    for c, own in cells.items():
        behind = cells.get(c + 1)
        if behind is not None:
            yield c * width, sorted(own | behind)
        elif c - 1 not in cells:
            yield c * width, sorted(own)


def phrase_places(ws: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """``(start, label)`` of every place where the words of a phrase stand next to each other."""
    places = []
    for phrase, label in phrases.items():
        at, n = -1, len(phrase)
        while True:
            try:
                at = ws.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(ws[at : at + n]) == phrase:
                places.append((at, label))
    return places


def word_counts(docs: DataFrame, vocabulary: set[str], text_col: str) -> dict[str, int]:
    """In how many documents each word of the templates occurs; as many rows as there are such words."""
    wanted = {w.encode() for w in vocabulary}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = dict.fromkeys(wanted, 0)
        for batch in parts:
            for text in batch.column(0).to_pylist():
                for w in wanted.intersection(license_words((text or "").encode("utf-8", "surrogatepass"))):
                    counts[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in counts], "n": list(counts.values())})

    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "word string, n bigint")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, *, whole: int = WHOLE,
    id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, matches)``.

    documents: ``row, doc_id, n_words, n_base, first_word, last_word, base_labels`` (an array);
    matches: ``row, block, template, overlap, containment``, one for every window and template
    that meet the threshold; ``block`` is the number of the window's first word.
    """
    named = {tuple(k.encode().split()): v for k, v in (PHRASES if phrases is None else phrases).items()}
    made = prepare(TEMPLATES if templates is None else templates, threshold, whole)
    counts = word_counts(docs, {w for t in made for w in t.words}, text_col)
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w.encode(): i for i, w in enumerate(order)}
    ranked = [sorted(rank[w.encode()] for w in t.words) for t in made]
    index = [
        (word, t.width, t.label, place, len(ws), t.need, ws)
        for t, ws in zip(made, ranked)
        for place, word in enumerate(ws[: len(ws) - t.need + 1])
    ]
    # Per width: the words that can start a match, and the fewest template words of a match.
    widths = {
        w: (frozenset(i[0] for i in index if i[1] == w), min(t.need for t in made if t.width == w))
        for w in sorted({t.width for t in made})
    }
    first_words = {order[i[0]].encode() for i in index}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: dict[str, list] = {k: [] for k in ("n", "base", "first", "last", "labels", "blocks")}
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                ws = license_words(raw)
                have = set(ws)
                places = phrase_places(ws, {p: v for p, v in named.items() if p and p[0] in have})
                at = [p for p, _ in places]
                out["n"].append(len(ws))
                out["base"].append(len(at))
                out["first"].append(min(at, default=None))
                out["last"].append(max(at, default=None))
                out["labels"].append(sorted({v for _, v in places}))
                found = []
                if not first_words.isdisjoint(have):
                    known = [(k, rank[w]) for k, w in enumerate(ws) if w in rank]
                    for width, (begins, least) in widths.items():
                        for k, own in windows(known, width):
                            if len(own) >= least and not begins.isdisjoint(own):
                                found.append({"block": k, "width": width, "words": own})
                out["blocks"].append(found)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(
                pa.struct([("block", pa.int64()), ("width", pa.int32()), ("words", pa.list_(pa.int32()))]))]
            arrays = [batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=NAMES)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels array<string>, blocks array<struct<block:bigint,width:int,words:array<int>>>"
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
    rows = cut(rows).withColumn("row", F.monotonically_increasing_id())

    spark = docs.sparkSession
    prefixes = spark.createDataFrame(
        index, "word int, width int, template string, t_at int, t_size int, need int, t_words array<int>"
    )
    block = rows.filter(F.size("blocks") > 0).select("row", F.inline("blocks"))
    size = F.size("words")
    shared = block.select("row", "block", "width", "words", F.posexplode("words").alias("b_at", "word")).join(
        F.broadcast(prefixes), ["word", "width"]
    )
    room = 1 + F.least(F.col("t_size") - F.col("t_at") - 1, size - F.col("b_at") - 1)
    candidates = shared.filter((size >= F.col("need")) & (room >= F.col("need")))
    overlap = F.size(F.array_intersect("words", "t_words"))
    matches = (
        candidates.withColumn("overlap", overlap)
        .filter("overlap >= need")
        .select("row", "block", "template", "overlap", (F.col("overlap") / F.col("t_size")).alias("containment"))
        .distinct()
    )
    return rows.drop("blocks"), matches


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]


def labels(docs: DataFrame, **options) -> DataFrame:
    """One row per document; ``labels`` adds the templates found to the base labels.

    ``score`` is 1 for a document with a base phrase, otherwise the best containment of a
    template found in it, otherwise 0.
    """
    rows, matches = scan(docs, **options)
    found = matches.groupBy("row").agg(F.collect_set("template").alias("more"), F.max("containment").alias("best"))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union("base_labels", F.coalesce("more", none)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), score.alias("score"),
    )
