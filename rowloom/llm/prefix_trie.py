"""The prefix trie of conversations, from sorted sequences of turns.

A conversation becomes the joined keys of its turns, 16 bytes each: a hash of
role and text and the length of the text. Sorted, all conversations that start
with the same turns lie side by side, so a node of the trie is an interval of
rows and a depth. Rows are sorted by range and cut into blocks. In a block, a
sparse table over the shared lengths of neighbours (LCPs) gives the least one
of any interval in two look-ups; each prefix that begins at a row finds how far
it reaches to the right, and its parent's prefix how far to the left, by its own
binary search in that table. What a node reports are differences of running
sums over its interval.

Only intervals that touch an end of their block can go on in the next. They
are few (a block has at most one for each depth and end), and a second sparse
table, with one entry for each block, tells in which block they begin. Their
parts are added up there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import ranges, stored

KEY = 16  # bytes of a turn: 12 of SHA-256, 4 of the length of its text
BLOCK = 1 << 17  # turns and rows of a block, at least, if there are as many
GROUP = 5  # conversations that are rebuilt from the same one
SHARED = 9  # they take up to SHARED - 1 of its turns
HEAD = 32  # characters of a text that order turns of equal number
FAR = np.iinfo(np.int64).max

PIECE = (
    "block long, row int, depth int, open boolean, tail boolean, conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved long, ends binary, parent_row int, parent_conv long,"
    " before long, least long, first binary, last binary"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, seq binary: the keys of every conversation's own turns, in order.

    Turns are ordered by number (null first), equal ones by role, the first 32
    characters of the text and the key. Null role or text counts as empty;
    rows without a conversation are left out. Repeated rows are turns of their
    own. A conversation's keys must fit into memory: 16 MB for a million turns.
    """
    turns = conversations.selectExpr(
        "CAST(conv_id AS LONG) AS conv_id",
        "turn",
        "coalesce(CAST(role AS STRING), '') AS role",
        "coalesce(CAST(text AS STRING), '') AS text",
    ).where("conv_id IS NOT NULL")
    digest = "sha2(concat(CAST(octet_length(role) AS STRING), ':', role, text), 256)"
    size = "lpad(hex(octet_length(text)), 8, '0')"
    return (
        turns.selectExpr(
            "conv_id",
            f"conv_id - conv_id % {GROUP} AS origin",
            f"struct(turn, role, left(text, {HEAD}) AS head,"
            f" unhex(concat(left({digest}, {2 * KEY - 8}), {size})) AS key) AS turn",
        )
        .repartition("origin")
        .groupBy("origin", "conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .selectExpr(
            "origin",
            "conv_id",
            "CAST(array_join(transform(turns, t -> CAST(t.key AS STRING)), '') AS BINARY) AS seq",
        )
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, seq: conversations that share a start with the first of their group.

    Conversation c begins with the first h turns of c - c % 5 (none if that is
    absent), then come its own after the first h; h is crc32(c) % 9.
    """
    start = Window.partitionBy("origin")
    head = F.expr(f"CASE WHEN conv_id = origin THEN substring(seq, 1, {KEY * (SHARED - 1)}) END")
    return (
        sequences(conversations)
        .withColumn("start", F.max(head).over(start))
        .selectExpr(
            "conv_id",
            "seq",
            "start",
            f"CAST(crc32(CAST(conv_id AS STRING)) % {SHARED} AS INT) * {KEY} AS h",
        )
        .selectExpr(
            "conv_id",
            "concat(coalesce(substring(start, 1, h), X''), substring(seq, h + 1)) AS seq",
        )
    )


class Minima:
    """A sparse table: the least value of every run whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value from a to b, both included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(k)) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all values after `at` are `least` or more."""
        at, n = at.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            step, row = 1 << k, self.rows[k]
            fits = at + step < n
            fits[fits] = row[at[fits] + 1] >= least[fits]
            at[fits] += step
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which all values after it, up to `at`, are `least` or more."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            step, row = 1 << k, self.rows[k]
            fits = at >= step
            fits[fits] = row[at[fits] - step + 1] >= least[fits]
            at[fits] -= step
        return at


def sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def shared_turns(keys: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many keys, `most` at most, are equal from places a and from places b on."""
    out = most.copy()
    some = np.flatnonzero(most)
    if len(some):
        counts = most[some]
        step = ranges(counts)
        one, other = np.repeat(a[some], counts) + step, np.repeat(b[some], counts) + step
        same = (keys[one] == keys[other]).all(axis=1)
        first = np.where(same, np.repeat(counts, counts), step)
        out[some] = np.minimum.reduceat(first, np.cumsum(counts) - counts)
    return out


def sizes_of(raw: bytes) -> np.ndarray:
    """The lengths of the texts, from the keys."""
    return np.frombuffer(raw, np.uint8).reshape(-1, KEY)[:, KEY - 4 :].copy().view(">u4")[:, 0]


def nodes_of(block: int, conv: np.ndarray, seqs: list[bytes]) -> pa.RecordBatch:
    """The nodes of a block of sorted rows, and a row with the block's ends.

    A node that touches an end of the block is open: its values are those of
    its part here, and `ends` lists the conversations that end in it.
    """
    raw, n = b"".join(seqs), len(seqs)
    size = np.fromiter(map(len, seqs), np.int64, n) // KEY
    start = sums(size)
    keys = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    letters = sums(sizes_of(raw))

    def letters_of(row: np.ndarray, turns: np.ndarray) -> np.ndarray:
        return letters[start[row] + turns] - letters[start[row]]

    rows = np.arange(n)
    shared = np.full(n, -1, np.int64)
    shared[1:] = shared_turns(keys, start[1:n], start[: n - 1], np.minimum(size[1:], size[:-1]))
    lcp, least_conv = Minima(shared), Minima(conv)

    # A prefix begins at the row where fewer turns than its own are shared.
    count = size - shared
    offset = sums(count)
    row = np.repeat(rows, count)
    depth = np.repeat(shared, count) + 1 + ranges(count)
    stop = lcp.right(row, depth)
    up = np.flatnonzero(depth)
    parent_row = np.full(len(row), -1, np.int64)
    parent_row[up] = lcp.left(row[up], depth[up] - 1)
    parent = np.zeros(len(row), np.int64)
    parent[up] = offset[parent_row[up]] + depth[up] - 2 - shared[parent_row[up]]

    members = stop - row + 1
    total = letters_of(rows, size)
    new = total - letters_of(rows, np.maximum(shared, 0))
    before = letters_of(row, np.maximum(depth - 1, 0))
    read, fresh = sums(total), sums(new)
    saved = read[stop + 1] - read[row] - members * before
    saved -= fresh[stop + 1] - fresh[row + 1] + total[row] - before
    forks = np.flatnonzero((size > shared) & (rows > 0))
    fork = np.sort(shared[forks] * n + forks)
    children = np.searchsorted(fork, depth * n + stop, "right") - np.searchsorted(fork, depth * n + row, "right")
    children += size[row] > depth
    # The last row is a leaf or not by the next block.
    leaf = np.zeros(n, bool)
    leaf[:-1] = shared[1:] < size[:-1]
    of_leaves = sums(leaf)
    leaves = of_leaves[stop + 1] - of_leaves[row]
    conv_of = least_conv.between(row, stop)
    tail = stop == n - 1
    is_open = tail | (row == 0)

    ends: list[bytes | None] = [None] * len(row)
    same = np.zeros(n, bool)
    same[1:] = (shared[1:] == size[1:]) & (shared[1:] == size[:-1])
    runs = np.flatnonzero(~same)
    for a, b in zip(runs, [*runs[1:], n]):
        at = int(offset[a + 1]) - 1
        listed = b",".join([b"%d" % c for c in conv[a:b]])
        ends[at] = listed if is_open[at] else hashlib.sha256(listed).digest()

    known = (depth > 0) & ~is_open[parent]
    columns = {
        "block": pa.array(np.full(len(row), block)),
        "row": pa.array(row.astype(np.int32)),
        "depth": pa.array(depth.astype(np.int32)),
        "open": pa.array(is_open),
        "tail": pa.array(tail),
        "conv_id": pa.array(conv_of),
        "n_convs": pa.array(members),
        "n_children": pa.array(children.astype(np.int64)),
        "n_leaves": pa.array(leaves),
        "saved": pa.array(saved),
        "ends": pa.array(ends, pa.binary()),
        "parent_row": pa.array(parent_row.astype(np.int32)),
        "parent_conv": pa.array(conv_of[parent], mask=~known),
        "before": pa.array(before),
    }
    nodes = pa.table(columns)
    edge = pa.table(
        {
            "block": pa.array([block]),
            "depth": pa.array([-1], pa.int32()),
            "open": pa.array([False]),
            "least": pa.array([int(shared[1:].min(initial=FAR))]),
            "first": pa.array([seqs[0]], pa.binary()),
            "last": pa.array([seqs[-1]], pa.binary()),
        }
    )
    both = pa.concat_tables([nodes, edge], promote_options="default")
    order = [c.split()[0] for c in PIECE.split(", ")]
    return both.select(order).combine_chunks().to_batches()[0]


def sorted_pieces(rows: DataFrame, size: int) -> DataFrame:
    """Cut every sorted partition into blocks, whose numbers are in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, conv, seqs, weight = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                conv.append(c)
                seqs.append(s)
                weight += 1 + len(s) // KEY
                if weight >= size:
                    yield nodes_of(block, np.array(conv, np.int64), seqs)
                    block, conv, seqs, weight = block + 1, [], [], 0
        if seqs:
            yield nodes_of(block, np.array(conv, np.int64), seqs)

    return rows.select("conv_id", "seq").mapInArrow(run, PIECE)


def edges_of(pieces: DataFrame) -> np.ndarray:
    """For each block, in order: its number, the turns it shares with the block before, the letters
    of these, the least number shared by neighbours inside, and the turns of its last row.

    This is a row of 40 bytes for each BLOCK of turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lcp, letters = [], []
            for first, last in zip(batch["first"].to_pylist(), batch["previous"].to_pylist()):
                n = -1
                if last is not None:
                    n = min(len(first), len(last)) // KEY
                    one, other = (np.frombuffer(s, np.uint64).reshape(-1, 2)[:n] for s in (first, last))
                    unlike = np.flatnonzero((one != other).any(axis=1))
                    n = int(unlike[0]) if len(unlike) else n
                lcp.append(n)
                letters.append(int(sizes_of(first)[: max(n, 0)].sum(dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["block"], pa.array(lcp, pa.int64()), pa.array(letters, pa.int64()), batch["least"], batch["size"]],
                ["block", "lcp", "letters", "least", "size"],
            )

    in_order = Window.orderBy("block")
    found = (
        pieces.where("depth = -1")
        .withColumn("previous", F.lag("last").over(in_order))
        .selectExpr("block", "first", "previous", "least", f"CAST(length(last) / {KEY} AS LONG) AS size")
        .mapInArrow(run, "block long, lcp long, letters long, least long, size long")
    )
    rows = sorted(found.collect())
    return np.array(rows, np.int64).reshape(-1, 5).T


def assign(pieces: DataFrame, edges: np.ndarray) -> DataFrame:
    """Open parts with the block and side where their node begins, and their values put right."""
    block, lcp, letters, least, size = edges
    least = np.minimum(lcp, least)
    leaf = np.append(lcp[1:], -1) < size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block whose value is a node's depth or more is all within it, and so is the end of
        # the one before.
        table = Minima(least)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.searchsorted(block, batch["block"].to_numpy())
            depth = batch["depth"].to_numpy().astype(np.int64)
            tail = batch["tail"].to_numpy(zero_copy_only=False)
            goes_on = (batch["row"].to_numpy() == 0) & (depth <= lcp[at])
            owner = at.copy()
            owner[goes_on] = table.left(at[goes_on] - 1, depth[goes_on])
            children = batch["n_children"].to_numpy() - (goes_on & (lcp[at] > depth))
            leaves = batch["n_leaves"].to_numpy() + (tail & leaf[at])
            saved = batch["saved"].to_numpy() + np.where(goes_on, letters[at] - batch["before"].to_numpy(), 0)
            new = {
                "owner": pa.array(block[owner]),
                "side": pa.array(tail | goes_on),
                "n_children": pa.array(children),
                "n_leaves": pa.array(leaves),
                "saved": pa.array(saved),
            }
            names = [f.split()[0] for f in ASSIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in names], names)

    columns = "block, row, depth, tail, conv_id, n_convs, n_children, n_leaves, saved, ends, parent_row, before"
    return pieces.where("open").selectExpr(*columns.split(", ")).mapInArrow(run, ASSIGNED)


ASSIGNED = (
    "owner long, side boolean, depth int, block long, row int, conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved long, ends binary, parent_row int"
)
WHOLE = (
    "owner long, side boolean, depth int, conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved long, ends binary, parent_row int"
)


def added(parts: DataFrame) -> DataFrame:
    """Open nodes as wholes. Parts are read in order, one at a time, as the hash goes over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        names = [f.split()[0] for f in WHOLE.split(", ")]
        for key, group in groupby(rows, key=lambda r: r[:3]):
            digest, listed, conv, values, parent = hashlib.sha256(), False, None, [0] * 4, None
            for *_, c, n, children, leaves, saved, ends, parent_row in group:
                if ends is not None:
                    digest.update(b"," + ends if listed else ends)
                    listed = True
                parent = parent_row if parent is None else parent
                conv = c if conv is None else min(conv, c)
                values = [a + b for a, b in zip(values, (n, children, leaves, saved))]
            out = [*key, conv, *values, digest.digest() if listed else None, parent]
            yield pa.RecordBatch.from_pylist([dict(zip(names, out))], schema=SCHEMA)

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    SCHEMA = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in WHOLE.split(", ")])
    ordered = parts.repartition("owner", "side", "depth").sortWithinPartitions("owner", "side", "depth", "block")
    return ordered.drop("block", "row").mapInArrow(run, WHOLE)


def prefix_trie(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct prefix of the sequences (conv_id long, seq binary).

    conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256. No rows give
    no nodes; rows without turns are members of the root alone; equal
    sequences, however many, are members of the same nodes; conv_id is unique
    and not null. Groups of equal sequences are split over blocks like others.
    """
    in_order = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = stored(sorted_pieces(in_order, block), "trie-pieces")
    parts = stored(assign(pieces, edges_of(pieces)), "trie-parts")
    whole = added(parts)
    heads = parts.join(
        whole.selectExpr("owner", "side", "depth", "conv_id AS head"), ["owner", "side", "depth"]
    ).selectExpr("block", "row AS parent_row", "depth + 1 AS depth", "head")
    values = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    closed = pieces.where("depth >= 0 AND NOT open")
    orphans = (
        closed.where("parent_conv IS NULL")
        .select("block", "parent_row", *values)
        .unionByName(whole.selectExpr("owner AS block", "parent_row", *values))
    )
    nodes = orphans.join(heads, ["block", "parent_row", "depth"], "left").select(*values, F.col("head").alias("parent"))
    nodes = nodes.unionByName(
        closed.where("parent_conv IS NOT NULL").select(*values, F.col("parent_conv").alias("parent"))
    )
    return nodes.selectExpr(
        "conv_id",
        "CAST(depth AS LONG) AS depth",
        "parent AS parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved AS saved_tokens",
        "coalesce(lower(hex(ends)), sha2('', 256)) AS ends_sha256",
    )


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """`prefix_trie` of the `rebuilt` conversations.

    Null turns come first, null role or text is empty, rows without conv_id are
    left out, repeated rows are turns of their own, an empty table has no
    nodes, other columns are not read. A very long conversation is one row.
    """
    return prefix_trie(rebuilt(conversations), block)
