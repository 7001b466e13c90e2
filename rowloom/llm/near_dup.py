"""Near copies by weighted MinHash (BagMinHash), bands and exact verification.

A text is the multiset of its word shingles. Every shingle starts Poisson
processes over the discretised weight axis: one for the interval [0, 1), then
one for each [2^(j-1), 2^j), at the rate of the interval's length. A point has
a time, a place on the axis and one of ``SLOTS`` slots; it counts if its place
is below the shingle's multiplicity. The signature of a text holds, for every
slot, its earliest point; two texts share it with a probability equal to their
weighted Jaccard similarity. Points are made in order of time and only up to a
time by which all slots are filled, so that most shingles cost one hash.

Texts that share a band of the signature are candidates, if all slots together
allow the similarity. Candidates, taken along chains, form families. A task
holds a family's multisets and finds its classes by exact overlap; it gives out
a class for each text, never pairs. Families too large for a task are dealt
over several, whose classes are joined by their central texts; then the texts
outside a family's largest class meet all others, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import (
    ODD,
    SIMILARITY,
    hash_spans,
    map_pieces,
    mix,
    pieces,
    ranges,
    row_shingles,
    words_of,
)
from rowloom.session import remove_folder, work_folder

SLOTS = 64
BAND = 4  # slots of a band: similarity 0.8 is missed by all 16 with a chance of 0.0002
FILLED = 4.0  # a slot stays empty with a chance of exp(-FILLED) / SLOTS
SHARED = 35  # slots that a pair shares but for a chance of 3 in a million if its similarity is 0.8
BUCKET = 1_000  # texts of a band that a task compares; larger bands are a family each
FAMILY = 2_000_000  # elements of multisets that a task holds
CORE = 8  # texts of a class that stand for it elsewhere


class Work:
    """Tables written on the way, to be removed together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
        path = work_folder(self.spark, f"near-{label}")
        df.write.parquet(path)
        self.folders.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.folders:
            remove_folder(self.spark, path)


def multisets(shingles: np.ndarray, counts: np.ndarray):
    """Distinct shingles with their multiplicities: row, value, times."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingles, row))
    value, row = shingles[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(value)))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def points(row, value, times, until):
    """All counted points up to a time for each row: row, slot, time, identity."""
    out = []
    level = 0
    active = np.arange(len(value))
    while len(active):
        begin, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        who, t, n = active, np.zeros(len(active)), 0
        while len(who):
            n += 1
            seed = mix(value[who] + np.uint64((level * 1_000_003 + n) * ODD & (2**64 - 1)))
            t = t - np.log(unit(seed)) / width
            early = t <= until[row[who]]
            who, t, seed = who[early], t[early], seed[early]
            place = mix(seed ^ np.uint64(0x5851F42D4C957F2D))
            inside = begin + width * unit(place) <= times[who] if level else np.ones(len(who), bool)
            if inside.any():
                slot = (mix(seed + np.uint64(ODD)) & np.uint64(SLOTS - 1)).astype(np.int64)
                out.append((row[who][inside], slot[inside], t[inside], seed[inside]))
        level += 1
        active = active[times[active] > 2 ** (level - 1)]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SLOTS values for each row; rows without shingles get zeros."""
    row, value, times = multisets(shingles, counts)
    n_rows = len(counts)
    result = np.zeros((n_rows, SLOTS), np.uint64)
    until = SLOTS * (np.log(SLOTS) + FILLED) / np.maximum(1, counts)
    while len(row):
        r, slot, t, seed = points(row, value, times, until)
        order = np.lexsort((seed, t, r * SLOTS + slot))
        key = (r * SLOTS + slot)[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        result.reshape(-1)[key[first]] = seed[order][first]
        full = np.bincount(key[first] // SLOTS, minlength=n_rows) == SLOTS
        left = ~full[row]
        row, value, times = row[left], value[left], times[left]
        until = until * 2
    return result


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of every band of each signature."""
    groups = signature.reshape(len(signature), SLOTS // BAND, BAND)
    out = np.full(groups.shape[:2], ODD, np.uint64)
    out += np.arange(groups.shape[1], dtype=np.uint64)[None, :] << np.uint64(32)
    for j in range(BAND):
        out = mix(out * np.uint64(0xA0761D6478BD642F) + groups[:, :, j])
    return out


def text_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the whole word sequence of each row."""
    raw = np.frombuffer(words.tobytes(), np.uint8)
    return hash_spans(raw, first[:-1] * 8, first[1:] * 8, lower=False)


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, node (a hash of the text's words), bands, signature and size.

    Texts without words are left out. The signature is kept to 16 bits a slot.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, first = words_of(piece.column(1))
        shingles, counts = row_shingles(words, first)
        slots = signatures(shingles, counts)
        hashes = bands(slots).astype(np.int64)
        short = [row.tobytes() for row in slots.astype(np.uint16)]
        n = hashes.shape[1]
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, (len(counts) + 1) * n, n, dtype=np.int32)),
            pa.array(hashes.reshape(-1)),
        )
        nodes = pa.array(text_keys(words, first).astype(np.int64))
        out = pa.RecordBatch.from_arrays(
            [piece.column(0), nodes, lists, pa.array(short, pa.binary()), pa.array(counts)],
            ["doc_id", "node", "bands", "slots", "size"],
        )
        return out.filter(pa.array(counts > 0))

    return map_pieces(
        documents, work, "doc_id long, node long, bands array<long>, slots binary, size long"
    )


def elements(texts: DataFrame) -> DataFrame:
    """family, node, size, items: the elements of the multiset of each text, as bytes.

    Rows are (text, node, family, size); those whose text isn't the node's, as
    their id has several texts, are left out, and so are repeated ones of a task. The
    n-th occurrence of a shingle is an element of its own, so that the overlap
    of multisets is that of sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch):
                words, first = words_of(piece["text"])
                node = piece["node"].to_numpy()
                same = text_keys(words, first).astype(np.int64) == node
                keep = [i for i in np.flatnonzero(same).tolist() if int(node[i]) not in seen and not seen.add(int(node[i]))]
                if not keep:
                    continue
                shingles, counts = row_shingles(words, first)
                row, value, times = multisets(shingles, counts)
                nth = ranges(times).astype(np.uint64)
                items = mix(np.repeat(value, times) + nth * np.uint64(ODD))
                ends = np.cumsum(counts)
                blobs = [items[ends[i] - counts[i] : ends[i]].tobytes() for i in keep]
                at = pa.array(keep)
                columns = [piece[c].take(at) for c in ("family", "node", "size")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(blobs, pa.binary())], ["family", "node", "size", "items"]
                )

    rows = texts.select("text", "node", "family", "size")
    return rows.mapInArrow(run, "family long, node long, size long, items binary")


def merge(work: Work, labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node, comp for all nodes with links: the smallest node of each component.

    New edges are read as edges between the components so far. Components are
    hooked to smaller neighbours, chains of hooks are halved until none is
    left, and edges are renamed, until no edge joins two components.
    """
    ends = edges.selectExpr("explode(array(node, other)) AS node").distinct()
    if labels is None:
        labels = ends.selectExpr("node", "node AS comp")
    else:
        labels = (
            ends.join(labels, "node", "full")
            .selectExpr("node", "coalesce(comp, node) AS comp")
        )
    labels = work.stored(labels, "labels")

    def renamed(links: DataFrame, names: DataFrame) -> DataFrame:
        a = names.toDF("a", "to_a")
        b = names.toDF("b", "to_b")
        return (
            links.join(a, "a", "left")
            .join(b, "b", "left")
            .selectExpr("coalesce(to_a, a) AS x", "coalesce(to_b, b) AS y")
            .where("x <> y")
            .selectExpr("least(x, y) AS a", "greatest(x, y) AS b")
            .distinct()
        )

    links = work.stored(renamed(edges.selectExpr("node AS a", "other AS b"), labels), "links")
    while not links.isEmpty():
        hooks = work.stored(links.groupBy("b").agg(F.min("a").alias("root")), "hooks")
        while True:
            further = hooks.toDF("root", "next")
            jumped = hooks.join(further, "root", "left").selectExpr(
                "b", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"
            )
            jumped = work.stored(jumped, "hooks")
            hooks = jumped.select("b", "root")
            if jumped.where("moved").isEmpty():
                break
        labels = work.stored(
            labels.join(hooks.toDF("comp", "root"), "comp", "left").selectExpr(
                "node", "coalesce(root, comp) AS comp"
            ),
            "labels",
        )
        links = work.stored(renamed(links, hooks), "links")
    return labels


def classes(n: int, alike: Callable[[int, np.ndarray], np.ndarray], first: int = 0) -> np.ndarray:
    """A class for each of n members, such that members of different classes aren't alike.

    ``alike(i, others)`` tells which of the others are linked to i. A member is
    compared with all outside its class. That is done for every member which
    isn't in the largest class, so no link between two classes is missed, and a
    group of copies costs a few comparisons of one with all.
    """
    label = np.arange(n)
    done = np.zeros(n, bool)
    lead = first
    while True:
        others = np.flatnonzero(label != label[lead])
        hit = others[alike(lead, others)] if len(others) else others
        if len(hit):
            joined = np.zeros(n, bool)
            joined[label[hit]] = True
            label[joined[label]] = label[lead]
        done[lead] = True
        largest = np.bincount(label).argmax()
        todo = np.flatnonzero(~done & (label != largest))
        if not len(todo):
            return label
        lead = int(todo[0])


class Multisets:
    """The multisets of a family, and which of them are similar."""

    def __init__(self, items: list[np.ndarray], similarity: float):
        self.similarity = similarity
        self.sizes = np.fromiter(map(len, items), np.int64, len(items))
        self.starts = np.cumsum(self.sizes) - self.sizes
        _, self.ids, held = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        self.mark = np.zeros(len(held), np.int32)
        common = held[self.ids]
        # Elements that nobody else has can't be in an overlap.
        self.open = np.add.reduceat(common > 1, self.starts, dtype=np.int64) >= similarity * self.sizes - 1e-9
        weight = np.add.reduceat(common, self.starts) / self.sizes
        self.centre = int(np.where(self.open, weight, 0).argmax())

    def similarities(self, i: int, others: np.ndarray) -> np.ndarray:
        """Exact similarities of one with some others."""
        at = slice(self.starts[i], self.starts[i] + self.sizes[i])
        self.mark[self.ids[at]] = 1
        sizes = self.sizes[others]
        if 4 * len(others) > len(self.sizes):
            shared = np.add.reduceat(self.mark[self.ids], self.starts)[others]
        else:
            rows = np.repeat(self.starts[others], sizes) + ranges(sizes)
            shared = np.add.reduceat(self.mark[self.ids[rows]], np.cumsum(sizes) - sizes)
        self.mark[self.ids[at]] = 0
        return shared / (self.sizes[i] + sizes - shared)

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        if self.open[i]:
            sizes = self.sizes[others]
            near = np.minimum(sizes, self.sizes[i]) >= self.similarity * np.maximum(sizes, self.sizes[i]) - 1e-9
            some = np.flatnonzero(self.open[others] & near)
            if len(some):
                out[some] = self.similarities(i, others[some]) >= self.similarity
        return out


def by_group(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Rows of a key, which must be few enough for a task, given to ``work(rows)`` as a list.

    Rows are sorted by key and node within partitions and read one group at a
    time; ``work`` sees them without the keys, node first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow(schema)
        lines = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for _, group in groupby(lines, key=lambda r: r[: len(keys)]):
            out += work([r[len(keys) :] for r in group])
            if len(out) >= 10_000:
                yield batch_of(out, kinds)
                out = []
        if out:
            yield batch_of(out, kinds)

    rest = [c for c in rows.columns if c not in (*keys, "node")]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "node")
    return ordered.select(*keys, "node", *rest).mapInArrow(run, schema)


def to_arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def candidates(work: Work, nodes: DataFrame, similarity: float) -> DataFrame:
    """node, other: edges along which all pairs that share a band and may be similar are connected.

    Of a band's texts those are connected whose slots and sizes allow the
    similarity. A band of more than BUCKET texts connects all of them: that
    costs time later, never a link.
    """
    members = nodes.selectExpr("node", "explode(bands) AS bucket")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("other"))
    buckets = work.stored(buckets.where("n > 1"), "buckets")
    shared = work.stored(members.join(buckets, "bucket"), "members")
    large = shared.where(f"n > {BUCKET} AND node <> other").select("node", "other")
    small = shared.where(f"n <= {BUCKET}").select("bucket", "node").join(nodes.select("node", "slots", "size"), "node")

    def edges(rows: list[tuple]) -> list[tuple]:
        names = [r[0] for r in rows]
        signs = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(-1, SLOTS)
        sizes = np.array([r[2] for r in rows])

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            equal = (signs[others] == signs[i]).sum(axis=1)
            near = np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-9
            return near & (equal > SHARED)

        if len(rows) == 2:
            return [(names[1], names[0])] if alike(0, np.array([1]))[0] else []
        label = classes(len(rows), alike)
        first = {}
        return [(n, first[c]) for n, c in zip(names, label.tolist()) if first.setdefault(c, n) != n]

    few = by_group(small, ["bucket"], edges, "node long, other long")
    return work.stored(large.unionByName(few).distinct(), "edges")


def arrays(rows: list[tuple]) -> tuple[list[int], list[np.ndarray]]:
    """Nodes and elements of a group's rows, repeated nodes once."""
    names, items = [], []
    for node, raw, *_ in rows:
        if not names or names[-1] != node:
            names.append(node)
            items.append(np.frombuffer(raw, np.uint64))
    return names, items


def classes_of(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """node, other, core: for every row of (keys, node, items) the first node of its class.

    Of the largest class of each group, and of a group's first, some central
    texts are marked as core.
    """

    def find(group: list[tuple]) -> list[tuple]:
        names, items = arrays(group)
        if len(names) == 1:
            return [(names[0], names[0], True)]
        sets = Multisets(items, similarity)
        label = classes(len(names), sets.alike, sets.centre)
        largest = np.flatnonzero(label == np.bincount(label).argmax())
        core = set()
        if len(largest) <= CORE:
            core.update(largest.tolist())
        else:
            centre = sets.centre if label[sets.centre] == label[largest[0]] else int(largest[0])
            nearest = np.argsort(-sets.similarities(centre, largest), kind="stable")[:CORE]
            core.update(largest[nearest].tolist())
        first: dict[int, int] = {}
        return [(n, first.setdefault(c, n), i in core) for i, (n, c) in enumerate(zip(names, label.tolist()))]

    return by_group(rows.select(*keys, "node", "items"), keys, find, "node long, other long, core boolean")


def links_across(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """node, other: links of asking rows of (keys, node, items, comp, asks) to rows of other classes.

    One link for each asking row and class that it is linked to.
    """

    def find(group: list[tuple]) -> list[tuple]:
        asking = {r[0] for r in group if r[3]}
        comp = {r[0]: r[2] for r in group}
        names, items = arrays(group)
        if not asking or len(names) < 2:
            return []
        sets = Multisets(items, similarity)
        comps = np.array([comp[n] for n in names])
        out = []
        for i, name in enumerate(names):
            if name in asking:
                others = np.flatnonzero(comps != comps[i])
                hit = others[sets.alike(i, others)] if len(others) else others
                _, one = np.unique(comps[hit], return_index=True)
                out += [(name, names[j]) for j in hit[one].tolist()]
        return out

    columns = rows.select(*keys, "node", "items", "comp", "asks")
    return by_group(columns, keys, find, "node long, other long")


def large_families(work: Work, rows: DataFrame, sizes: DataFrame, similarity: float, limit: int) -> DataFrame:
    """node, comp of families (family, node, size, items) that no task can hold.

    ``sizes`` has the number of elements of each. Rows are dealt to parts that
    fit. Parts find their classes; their central texts, few as they are, join
    the classes of different parts. Then every text outside the largest class of
    its family meets the texts of all parts. So each pair of texts of one
    family is either in one class or was compared.
    """
    parts = sizes.selectExpr("family", f"CAST(ceil(2 * weight / {limit}) AS INT) AS parts")
    dealt = rows.join(parts, "family").selectExpr("*", "CAST(pmod(xxhash64(node), parts) AS INT) AS part")
    dealt = work.stored(dealt, "dealt")
    found = work.stored(classes_of(dealt, ["family", "part"], similarity), "part-classes")
    labels = merge(work, None, found.select("node", "other"))
    core = dealt.join(found.where("core").select("node"), "node", "left_semi").drop("parts", "part")
    core = work.stored(core.select("family", "node", "size", "items"), "core")
    # Parts of a few long texts are all core: nothing is gained then.
    if 2 * core.count() <= dealt.count():
        among = families(work, core, similarity, limit)
        labels = merge(work, labels, among.selectExpr("node", "comp AS other"))
    named = dealt.join(labels, "node")
    counts = named.groupBy("family", "comp").agg(F.count("*").alias("n"))
    largest = counts.groupBy("family").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    named = work.stored(named.join(work.stored(largest, "largest"), "family"), "named")
    asking = named.where("comp <> main")
    blocks = asking.groupBy("family").agg(F.expr(f"CAST(ceil(2 * sum(size) / {limit}) AS INT) AS blocks"))
    blocks = work.stored(blocks, "blocks")
    asks = asking.join(blocks, "family").selectExpr(
        "family",
        "explode(sequence(0, parts - 1)) AS part",
        "CAST(pmod(xxhash64(node, 1), blocks) AS INT) AS block",
        "node",
        "items",
        "comp",
        "TRUE AS asks",
    )
    others = named.join(blocks, "family").selectExpr(
        "family", "part", "explode(sequence(0, blocks - 1)) AS block", "node", "items", "comp", "FALSE AS asks"
    )
    across = links_across(asks.unionByName(others), ["family", "part", "block"], similarity)
    return merge(work, labels, work.stored(across, "across"))


def families(work: Work, rows: DataFrame, similarity: float, limit: int) -> DataFrame:
    """node, comp: the classes of all families of (family, node, size, items)."""
    sizes = work.stored(rows.groupBy("family").agg(F.sum("size").alias("weight")), "family-sizes")
    few = rows.join(sizes.where(f"weight <= {limit}").select("family"), "family", "left_semi")
    found = classes_of(few, ["family"], similarity).selectExpr("node", "other AS comp")
    big = work.stored(sizes.where(f"weight > {limit}"), "large")
    if not big.isEmpty():
        many = rows.join(big.select("family"), "family", "left_semi")
        found = found.unionByName(large_families(work, many, big, similarity, limit))
    return work.stored(found, "classes")


def components(
    work: Work, documents: DataFrame, similarity: float = SIMILARITY, limit: int = FAMILY
) -> DataFrame:
    """doc_id, node, comp for every row with an id and a word; nodes of one class share their comp."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    rows = work.stored(sketch(docs), "rows")
    nodes = rows.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("bands").alias("bands"),
        F.first("slots").alias("slots"),
        F.first("size").alias("size"),
    )
    nodes = work.stored(nodes, "nodes")
    edges = candidates(work, nodes, similarity)
    ids = rows.select("doc_id", "node")
    if edges.isEmpty():
        return ids.selectExpr("doc_id", "node", "node AS comp")
    chains = merge(work, None, edges).selectExpr("node", "comp AS family")
    chains = work.stored(chains.join(nodes.select("node", "doc_id", "size"), "node"), "chains")
    # Not broadcast: which texts have relatives is a list that grows with the documents.
    texts = elements(docs.join(chains.hint("merge"), "doc_id"))
    labels = families(work, work.stored(texts, "texts"), similarity, limit)
    return ids.join(labels, "node", "left").selectExpr("doc_id", "node", "coalesce(comp, node) AS comp")


def classified(documents: DataFrame, similarity: float, limit: int = FAMILY) -> DataFrame:
    """doc_id, node, class_id, class_node: the smallest id of the class, and its node, for each row with words.

    What was written on the way is removed, but for the result.
    """
    spark = documents.sparkSession
    work, last = Work(spark), Work(spark)
    try:
        rows = work.stored(components(work, documents, similarity, limit), "rows-classes")
        least = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("least"))
        named = rows.join(work.stored(least, "least"), "comp")
        return last.stored(
            named.selectExpr("doc_id", "node", "least.doc_id AS class_id", "least.node AS class_node"), "result"
        )
    finally:
        work.clear()


NO_WORDS = "text IS NULL OR NOT text RLIKE '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]'"


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, limit: int = FAMILY) -> DataFrame:
    """doc_id, class_id: the smallest id of the documents that are linked, directly or not.

    Two texts are linked if the weighted Jaccard similarity of their multisets
    of five-word shingles is at least `similarity`. Texts of one to four words
    have one shingle, all of their words. A null or empty text, or one without
    words, is alone in its class; a null id has no class and stays null.
    Repeated rows give repeated results, an empty table none. Other columns are
    not read. A text of any length is one row of 8 bytes a word; a task holds
    `limit` of them, or one text.
    """
    with_words = classified(documents, similarity, limit).select("doc_id", "class_id")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    without = ids.where(f"doc_id IS NULL OR {NO_WORDS}").selectExpr("doc_id", "doc_id AS class_id")
    return with_words.unionByName(without)


def with_nodes(documents: DataFrame) -> DataFrame:
    """The rows with a column that `sketch` calls node, null where a text has no word."""
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = words_of(batch.column(place))
            none = np.diff(first) == 0
            nodes = pa.array(text_keys(words, first).astype(np.int64), mask=none)
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, NODE])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(NODE, T.LongType())]))


NODE = "node of the text"


def drop_near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, limit: int = FAMILY) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns.

    Rows without an id or without words stay. Of rows that repeat id and text
    one stays. An id with several texts loses only those that are copies.
    """
    rows = classified(documents, similarity, limit)
    last = Work(documents.sparkSession)
    ids = documents.selectExpr("CAST(doc_id AS LONG) AS doc_id").where("doc_id IS NOT NULL")
    often = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    often = last.stored(often, "often")
    lost = last.stored(
        rows.where("doc_id <> class_id OR node <> class_node").select("doc_id", "node").distinct(), "lost"
    )
    kept = documents.join(lost.join(often, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_anti")
    if not often.isEmpty():
        once = kept.join(often, "doc_id", "left_anti")
        several = with_nodes(documents.select(*[F.col(f"`{c}`") for c in documents.columns]).join(often, "doc_id", "left_semi"))
        copies = lost.selectExpr("doc_id", f"node AS `{NODE}`")
        several = several.join(copies, ["doc_id", NODE], "left_anti")
        worded = several.where(F.col(NODE).isNotNull()).dropDuplicates(["doc_id", NODE])
        wordless = several.where(F.col(NODE).isNull()).dropDuplicates(["doc_id", "text"])
        kept = once.unionByName(worded.unionByName(wordless).drop(NODE))
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
