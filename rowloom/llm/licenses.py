"""License phrases and texts in documents, by diagonal voting.

The hashes of all runs of words of all documents are joined to those of the
templates: runs of up to four words for phrases, of two for texts. A hit votes
for a diagonal, the document's position less the template's. Votes are counted
by diagonal, and neighbouring diagonals are merged (words put in or left out
shift the rest).

A phrase is found where a diagonal has all of its runs. A text may have changed
words, each of which costs two votes; a merged run of few votes is a region
that may hold it. Regions are verified on their words: a text is found if a
span of fitting length has enough of its words in order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rowloom.llm.common import map_pieces, stored, windows, words_of

RUN, TEXT_RUN = 4, 2  # words of a run of a phrase (a shorter one is one run) and of a text
GAP = 6  # diagonals at most so far apart are merged
COVER = 0.8  # of a text's words, that stand in order
STRETCH = 1.5  # longest span of a find, in lengths of the template
VOTES = 0.25  # of a text's runs, that make a region
BROADCAST_BYTES = 16 << 20  # of regions, up to which they are broadcast

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences of public licenses by which their texts are known.
TEXTS = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of"
    " this software and associated documentation files the software to deal in the software"
    " without restriction",
    "bsd-text": "redistribution and use in source and binary forms with or without modification"
    " are permitted provided that the following conditions are met",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose"
    " with or without fee is hereby granted provided that the above copyright notice and this"
    " permission notice appear in all copies",
    "apache-text": "you may not use this file except in compliance with the license you may"
    " obtain a copy of the license at",
    "gpl-text": "this program is free software you can redistribute it and or modify it under"
    " the terms of the gnu general public license as published by the free software foundation",
    "mpl-text": "this source code form is subject to the terms of the mozilla public license",
    "cc-by-text": "this work is licensed under a creative commons attribution",
    "unlicense-text": "this is free and unencumbered software released into the public domain",
}


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    return windows(words, k) ^ np.uint64(k)


def template_rows(texts: dict[str, str], base: bool) -> list[tuple]:
    """hash, template, place in it, its runs and words, whether it is a base phrase."""
    out = []
    for name, text in texts.items():
        words, _ = words_of(pa.array([text]))
        hashes = run_hashes(words, min(RUN, len(words)) if base else TEXT_RUN).astype(np.int64)
        out += [
            (h, name, place, len(hashes), len(words), base)
            for place, h in enumerate(hashes.tolist())
        ]
    return out


def scan_runs(documents: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, key, n_words, and the hashes of the runs of every size in turn."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, first = words_of(piece.column(1))
        every = [run_hashes(words, k).astype(np.int64) for k in sizes]
        parts, counts = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = [h[a : b - k + 1] for h, k in zip(every, sizes) if b - a >= k]
            counts.append(sum(map(len, own)))
            parts += own
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(2), pa.array(np.diff(first)), lists],
            ["doc_id", "key", "n_words", "runs"],
        )

    return map_pieces(documents, work, "doc_id long, key long, n_words long, runs array<long>")


class Text:
    """The words of a license text, to count those that a span has in order."""

    def __init__(self, name: str, text: str):
        self.name = name
        words = words_of(pa.array([text]))[0].tolist()
        self.size = len(words)
        self.need = math.ceil(COVER * self.size - 1e-9)
        self.span = int(STRETCH * self.size)
        self.all = (1 << self.size) - 1
        self.places: dict[int, int] = {}
        for i, w in enumerate(words):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def common(self, words: list[int]) -> int:
        """The length of the longest common subsequence, one bit a word of the text."""
        rest = self.all
        for w in words:
            at = rest & self.places.get(w, 0)
            if at:
                rest = ((rest + at) | (rest - at)) & self.all
        return self.size - rest.bit_count()


def share_in(words: np.ndarray, text: Text) -> float:
    """The largest share of a text's words that a span of fitting length has in order; 0 if too small."""
    own = np.isin(words, np.fromiter(text.places, np.uint64, len(text.places)))
    sums = np.concatenate([[0], np.cumsum(own)])
    stops = np.minimum(np.arange(len(words)) + text.span, len(words))
    best = 0
    for at in np.flatnonzero(own & (sums[stops] - sums[:-1] >= text.need)).tolist():
        best = max(best, text.common(words[at : at + text.span].tolist()))
        if best == text.size:
            break
    return best / text.size if best >= text.need else 0.0


def verify(documents: DataFrame) -> DataFrame:
    """The rows with n_words, texts (those found in their regions) and share (the largest).

    A region has a template's name, and the first and last place of its votes;
    the rest of the text may lie on either side.
    """
    texts = {name: Text(name, text) for name, text in TEXTS.items()}
    kept = [f for f in documents.schema.fields if f.name not in ("text", "regions")]

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, first = words_of(piece["text"])
        found: list[dict[str, float]] = [{} for _ in range(piece.num_rows)]
        for r, regions in enumerate(piece["regions"].to_pylist()):
            for region in regions or ():
                text = texts[region["template"]]
                begin = max(int(first[r]), int(first[r]) + region["start"] - text.span)
                end = min(int(first[r + 1]), int(first[r]) + region["last"] + TEXT_RUN + text.span)
                share = share_in(words[begin:end], text)
                if share > found[r].get(text.name, 0.0):
                    found[r][text.name] = share
        columns = [piece[f.name] for f in kept]
        columns.append(pa.array(np.diff(first)))
        columns.append(pa.array([list(f) for f in found], pa.list_(pa.string())))
        columns.append(pa.array([max(f.values(), default=0.0) for f in found], pa.float64()))
        return pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "n_words", "texts", "share"])

    schema = T.StructType([*kept]).add("n_words", "long").add("texts", T.ArrayType(T.StringType())).add("share", "double")
    return map_pieces(documents, work, schema)


def vote(documents: DataFrame) -> DataFrame:
    """doc_id, key, template, base, place, diagonal: every hit of a template's run once.

    The templates are a fixed list of some hundred runs, which is broadcast.
    """
    rows = template_rows({p: p for p in PHRASES}, True) + template_rows(TEXTS, False)
    sizes = sorted({min(RUN, r[4]) for r in rows})
    templates = documents.sparkSession.createDataFrame(
        rows, "hash long, template string, place int, runs int, words int, base boolean"
    )
    # a position in the list of runs is one of the first size, then one of the next, ...
    at, shift = "CASE", "0"
    for k in sizes:
        at += f" WHEN i < {shift} + greatest(n_words - {k} + 1, 0) THEN i - ({shift})"
        shift += f" + greatest(n_words - {k} + 1, 0)"
    runs = scan_runs(documents, sizes).selectExpr(
        "doc_id", "key", "n_words", "posexplode(runs) AS (i, hash)"
    )
    hits = runs.join(F.broadcast(templates), "hash").selectExpr(
        "doc_id",
        "key",
        "template",
        "base",
        "runs",
        "words",
        "place",
        f"cast({at} END AS bigint) - place AS diagonal",
    )
    # rows that repeat id and text count once
    return hits.distinct()


def merged(documents: DataFrame) -> DataFrame:
    """doc_id, key, template, base, runs, words, n, start, last: votes of merged diagonals.

    A phrase's diagonals stay apart. n counts the places of the template.
    """
    who = ["doc_id", "key", "template", "base", "runs", "words"]
    diagonals = vote(documents).groupBy(*who, "diagonal").agg(
        F.collect_set("place").alias("places"),
        F.min(F.col("diagonal") + F.col("place")).alias("low"),
        F.max(F.col("diagonal") + F.col("place")).alias("high"),
    )
    order = Window.partitionBy(*who).orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > GAP), 1)
    return (
        diagonals.withColumn("part", F.sum(F.coalesce(apart, F.lit(0))).over(order))
        .groupBy(*who, "part")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"),
            F.min("low").alias("start"),
            F.max("high").alias("last"),
        )
    )


def finds(documents: DataFrame) -> DataFrame:
    """id, other_key, starts and labels of a row's phrases, and regions of its texts."""
    names = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    enough = f"CASE WHEN base THEN n = runs ELSE n >= greatest(2, {VOTES}D * runs) END"
    region = F.struct("template", "start", "last")
    return (
        merged(documents)
        .where(enough)
        .withColumn("label", names[F.col("template")])
        .groupBy(F.col("doc_id").alias("id"), F.col("key").alias("other_key"))
        .agg(
            F.count(F.when(F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            F.collect_list(F.when(~F.col("base"), region)).alias("regions"),
        )
    )


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row for each row of documents. Texts without words, null or empty ones
    have no finds; repeated rows give repeated results, a null id stays null,
    other columns are not read. The score is 1 with a phrase, else the largest
    share of a text's words in order that was found, 0 without a find. Texts
    of any length are read whole.
    """
    docs = documents.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.xxhash64(F.col("text").cast("string")).alias("key"),
    )
    found = stored(finds(docs), "license-finds")
    size = found.agg(F.sum(F.lit(96) + 48 * F.size("regions"))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else texts are shuffled by id and key
        found = F.broadcast(found)
    rows = docs.join(found, F.expr("doc_id <=> id AND key = other_key"), "left")
    checked = verify(rows.select("doc_id", "text", "n_base", "first_word", "last_word", "base_labels", "regions"))
    return checked.selectExpr(
        "doc_id",
        "n_words",
        "coalesce(n_base, 0L) AS n_base",
        "first_word",
        "last_word",
        "coalesce(array_join(array_sort(base_labels), ','), '') AS base_labels",
        "array_join(array_sort(array_union(coalesce(base_labels, array()), texts)), ',') AS labels",
        "greatest(CASE WHEN n_base > 0 THEN 1D ELSE 0D END, share) AS score",
    )
