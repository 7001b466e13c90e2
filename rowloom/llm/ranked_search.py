"""Ranked lexical search of many items at once, sharing what their scores have in common.

A score is a sum over terms. Terms that belong to the same items are one set;
neighbouring sets that several items have in common are joined, again and
again, to larger shared sets. The result is a graph: sets of terms below, sums
of two nodes above, items on top, where what several items need is one node. A
task goes over its documents in groups and keeps an accumulator of each node
for each of them: every shared sum is made once, then combined along the graph.

Documents are read once. Of their words, those of the items are kept as
postings in a table; counts of documents, words and document frequencies come
from the same pass. The second pass reads the postings. Items are taken in
blocks of bounded size; all documents meet each block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import pieces, ranges, stored, words_of

TOP = 10
BLOCK = 200_000  # terms of the items of a block, unless one item alone has more
CELLS = 1 << 22  # accumulators that a task holds at once
SCALE = 1_000_000_000


@dataclass
class Graph:
    """How the scores of a block of items are put together.

    set_of: the set of each term. left, right: the two parts of each node above
    the sets, level by level as `levels` says. tops, first: the nodes whose sum
    is an item's score, and where those of each item begin.
    """

    sets: int
    set_of: np.ndarray
    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]
    tops: np.ndarray
    first: np.ndarray
    nodes: int = field(init=False)

    def __post_init__(self) -> None:
        self.nodes = self.sets + len(self.left)

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """Scores (items by documents) from accumulators, those of the sets filled in."""
        for a, b in self.levels:
            at = slice(self.sets + a, self.sets + b)
            sums[at] = sums[self.left[a:b]] + sums[self.right[a:b]]
        return np.add.reduceat(sums[self.tops], self.first, axis=0)


def share(items: list[np.ndarray]) -> Graph:
    """Find sums that items have in common. Every item has a term at least."""
    terms = 1 + max(int(t.max()) for t in items)
    holders: dict[int, list[int]] = defaultdict(list)
    for i, item in enumerate(items):
        for t in item.tolist():
            holders[t].append(i)
    sets: dict[tuple[int, ...], int] = {}
    set_of = np.zeros(terms, np.int64)
    for t in sorted(holders, key=lambda t: (-len(holders[t]), holders[t], t)):
        set_of[t] = sets.setdefault(tuple(holders[t]), len(sets))
    # Sets that more items hold come first, so that neighbours tend to be shared.
    lists = [np.unique(set_of[item]).tolist() for item in items]
    left: list[int] = []
    right: list[int] = []
    levels = []
    while True:
        pairs = Counter(p for nodes in lists for p in zip(nodes, nodes[1:]))
        chosen = {p for p, n in pairs.items() if n > 1}
        if not chosen:
            break
        begin, joined = len(left), {}
        for i, nodes in enumerate(lists):
            out, k = [], 0
            while k < len(nodes):
                pair = tuple(nodes[k : k + 2])
                later = tuple(nodes[k + 1 : k + 3])
                # Of two pairs with a node in common, the more frequent one.
                if pair in chosen and not (later in chosen and pairs[later] > pairs[pair]):
                    if pair not in joined:
                        joined[pair] = len(sets) + len(left)
                        left.append(pair[0])
                        right.append(pair[1])
                    out.append(joined[pair])
                    k += 2
                else:
                    out.append(nodes[k])
                    k += 1
            lists[i] = out
        levels.append((begin, len(left)))
    tops = np.array([n for nodes in lists for n in nodes], np.int64)
    first = np.cumsum([0, *map(len, lists[:-1])])
    return Graph(len(sets), set_of, np.array(left, np.int64), np.array(right, np.int64), levels, tops, first)


def item_blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Distinct rows of the items as (item_id, terms), in blocks of about `size` terms.

    The terms are hashes. Items without a term are left out. The driver holds
    one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, first = words_of(piece.column(1))
                terms = [np.unique(words[a:b]).astype(np.int64) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"]
                )

    texts = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    found = texts.mapInArrow(run, "item_id long, terms array<long>").where("size(terms) > 0")
    block, weight = [], 0
    for row in found.toLocalIterator():
        if block and weight + len(row.terms) > size:
            yield block
            block, weight = [], 0
        block.append((row.item_id, np.array(row.terms, np.int64).view(np.uint64)))
        weight += len(row.terms)
    if block:
        yield block


POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>, documents long"


def postings(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """For each document with terms of the vocabulary: its number of words, the terms, how often.

    Each task adds a row with its totals: documents with a word, words, and for
    each term the documents that hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        documents, total, held = 0, 0, np.zeros(size, np.int32)
        for batch in batches:
            for piece in pieces(batch):
                words, first = words_of(piece.column(1))
                n = np.diff(first)
                documents += int((n > 0).sum())
                total += int(n.sum())
                at = np.searchsorted(vocabulary, words)
                at[at == size] = 0
                hit = np.flatnonzero(vocabulary[at] == words)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                pair, times = np.unique(doc * size + at[hit], return_counts=True)
                doc, term = np.divmod(pair, size)
                held += np.bincount(term, minlength=size).astype(np.int32)
                rows, begins = np.unique(doc, return_index=True)
                offsets = pa.array(np.append(begins, len(doc)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(rows)),
                        pa.array(n[rows].astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                        pa.nulls(len(rows), pa.int64()),
                    ],
                    ["doc_id", "n", "terms", "counts", "documents"],
                )
        some = np.flatnonzero(held).astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": [None], "n": [total], "terms": [some], "counts": [held[some]], "documents": [documents]},
            schema=pa.schema(
                [
                    ("doc_id", pa.int64()),
                    ("n", pa.int64()),
                    ("terms", pa.list_(pa.int32())),
                    ("counts", pa.list_(pa.int32())),
                    ("documents", pa.int64()),
                ]
            ),
        )

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, POSTINGS)


def weights_of(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a word, all words, and the weight of each term of the vocabulary."""
    totals = found.where("documents IS NOT NULL")
    counts = totals.agg(F.sum("documents"), F.sum("n")).first()
    documents, words = (int(c or 0) for c in counts)
    held = (
        totals.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        .groupBy("p.terms")
        .agg(F.sum("p.counts").alias("df"))
    )
    df = np.zeros(size, np.int64)
    for term, n in held.collect():
        df[term] = n
    weights = [floor(1000 * log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()]
    return documents, words, np.array(weights, np.int64)


def best(columns: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Of rows (item, score, null, doc_id) the `top` of each item, by score, then id, null last."""
    item, score, null, doc = columns
    order = np.lexsort((doc, null, -score, item))
    columns = [c[order] for c in columns]
    fresh = np.flatnonzero(np.diff(columns[0], prepend=-1))
    counts = np.diff(np.append(fresh, len(order)))
    keep = ranges(counts) < top
    return [c[keep] for c in columns]


def ranked(found: DataFrame, graph: Graph, ids: list, weights: np.ndarray, documents: int, words: int, top: int):
    """item, item_id, doc_id, score: the best documents of each task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64) for _ in range(4)]
        least = np.ones(len(ids), np.int64)  # scores that can still get in
        step = max(1, CELLS // graph.nodes)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.num_rows
                lists, counts = part["terms"], part["counts"]
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(n), size)
                term = lists.flatten().to_numpy(zero_copy_only=False)
                tf = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = 10 + (90 * documents * part["n"].to_numpy()) // max(words, 1)
                value = weights[term] * ((SCALE * tf) // (1000 * tf + 8 * m[doc]))
                sums = np.zeros((graph.nodes, n), np.int64)
                np.add.at(sums, (graph.set_of[term], doc), value)
                score = graph.scores(sums)
                item, column = np.nonzero(score >= least[:, None])
                if not len(item):
                    continue
                null = part["doc_id"].is_null().to_numpy(zero_copy_only=False)
                doc_id = part["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
                new = [item, score[item, column], null[column].astype(np.int64), doc_id[column]]
                kept = best([np.concatenate(c) for c in zip(kept, new)], top)
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(ids)) == top)
                ends = np.searchsorted(kept[0], full, "right") - 1
                least[full] = kept[1][ends]
        item, score, null, doc_id = kept
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item.astype(np.int32)),
                pa.array([ids[i] for i in item], pa.int64()),
                pa.array(doc_id, mask=null > 0),
                pa.array(score),
            ],
            ["item", "item_id", "doc_id", "score"],
        )

    rows = found.where("documents IS NULL").select("doc_id", "n", "terms", "counts")
    return rows.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item, by score, then by id.

    All documents are ranked for all items; documents with a score above 0 are
    listed, `top` for an item at most. Every row of the documents is one, also
    repeated ones; equal rows of the items are one item, and rows with the same
    id and other texts are items of their own, each with ranks from 1. Null ids
    come last among equal scores. Null and empty texts have no terms: such
    items have no rows and such documents aren't counted. Terms are compared by
    64-bit hashes. Texts of any length are read whole; other columns are not
    read. An empty table on either side gives no rows.
    """
    results = []
    for group in item_blocks(items, block):
        vocabulary, places = np.unique(np.concatenate([t for _, t in group]), return_inverse=True)
        ends = np.cumsum([len(t) for _, t in group])
        graph = share(np.split(places, ends[:-1]))
        found = stored(postings(documents, vocabulary), "search-postings")
        n, words, weights = weights_of(found, len(vocabulary))
        rows = ranked(found, graph, [i for i, _ in group], weights, n, words, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        results.append(rows.select("item_id", "rank", "doc_id", "score"))
    if not results:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)
