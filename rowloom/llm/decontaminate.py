"""Benchmark passages in documents.

Every benchmark item has a 32-bit SimHash of its word shingles. Windows of the
item's size slide over each document word by word; all their SimHashes come
from running sums that hold eight bit counters in one machine word. A window is
looked up in tables of 16-bit fingerprint blocks: of two fingerprints that
differ in at most ``RADIUS`` bits, one of the two blocks differs in at most
``RADIUS // 2``, and the tables hold all those neighbours, so that no
fingerprint within the radius is missed.

Fingerprints of similar passages can lie farther apart, so every item also has
keys: its rarest shingles, so many that a window with none of them cannot be
similar. Around each place that a fingerprint or a key points to, the weighted
Jaccard similarity of item and window is counted exactly for all windows, and
the result holds every similar passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import (
    SHINGLE_WORDS,
    SIMILARITY,
    map_pieces,
    pieces,
    ranges,
    stored,
    windows,
    words_of,
)

RADIUS = 7
LONGEST = 128  # words of the longest window; longer items are looked up by parts
CHUNK_CHARS = 20_000_000  # characters of benchmark text that one pass holds in each task

SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"

KNOWN_BITS = np.uint64((1 << 20) - 1)  # of a shingle, to tell that no item has it
SPREAD = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
BIAS = np.uint64(0x7F7F7F7F7F7F7F7F)  # a sum of 1 or more sets the upper bit of its byte
LANES = 4
BLOCKS = 2  # of 16 bits
OWN_BIT = np.uint16(0x0201)  # of each of two blocks, the bit of its own table


def size_class(n: int) -> int:
    """The window size for an item of n words: 8 sizes for each doubling.

    An item that is up to an eighth longer than its windows is looked up by its
    first and its last words, and verified as a whole.
    """
    n = min(n, LONGEST)
    step = 1 << max(0, n.bit_length() - 4)
    return n // step * step


def lanes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of +1 for a set and -1 for another bit, eight bits of the hash in each row."""
    out = np.zeros((LANES, len(hashes) + 1), np.uint64)
    for j in range(LANES):
        bits = (hashes >> np.uint64(j)) & SPREAD
        bits <<= np.uint64(1)
        bits -= SPREAD
        np.cumsum(bits, out=out[j, 1:])
    return out


def simhash(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of all windows of `size` shingles: a bit is set if over half have it."""
    n = sums.shape[1] - size
    out = np.zeros(n, np.uint64)
    x = np.empty(n, np.uint64)
    for j in range(LANES):
        np.subtract(sums[j, size:], sums[j, :n], out=x)
        x += BIAS
        x &= HIGH
        x >>= np.uint64(j)
        out |= x
    return pack(out)


def pack(x: np.ndarray) -> np.ndarray:
    """The upper four bits of each byte, in 32 bits."""
    x >>= np.uint64(4)
    x |= x >> np.uint64(4)
    x &= np.uint64(0x00FF00FF00FF00FF)
    x |= x >> np.uint64(8)
    x &= np.uint64(0x0000FFFF0000FFFF)
    x |= x >> np.uint64(16)
    return x.astype(np.uint32)


def neighbours(value: int, flips: int) -> list[int]:
    """All 16-bit values within so many flipped bits."""
    return [
        value ^ sum(1 << b for b in bits)
        for k in range(flips + 1)
        for bits in combinations(range(16), k)
    ]


class Class:
    """The items looked up with windows of one size, and their block tables."""

    def __init__(self, words: int, shingle: int):
        self.words, self.shingle, self.size = words, shingle, words - shingle + 1
        self.prints: list[int] = []
        self.items: list[tuple[int, int]] = []  # item, and where in it the window starts
        self.bound = math.inf  # shared shingles of a window without which no item can be similar

    def close(self) -> None:
        self.fingerprints = np.array(self.prints, np.uint32)
        self.numbers = np.array([number for number, _ in self.items], np.int64)
        masks = np.array(neighbours(0, RADIUS // BLOCKS), np.uint16)
        self.near = np.zeros(1 << 16, np.uint8)
        for j in range(BLOCKS):
            block = (self.fingerprints >> np.uint32(16 * j)).astype(np.uint16)
            table = np.zeros(1 << 16, bool)
            table[(block[:, None] ^ masks[None, :]).ravel()] = True
            self.near |= table.astype(np.uint8) << np.uint8(j)

    def candidates(self, prints: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items whose fingerprints differ in at most RADIUS bits.

        Windows that share too few shingles with all items together are left
        out before their bits are counted. `known` has running counts of them.
        """
        hit = np.take(self.near, prints.view(np.uint16)).view(np.uint16)
        at = np.flatnonzero(hit & OWN_BIT)
        at = at[known[at + self.size] - known[at] >= self.bound]
        where, which = np.nonzero(
            np.bitwise_count(prints[at][:, None] ^ self.fingerprints[None, :]) <= RADIUS
        )
        return at[where], which


class Keys:
    """The rarest shingles of every item with one shingle length.

    A window of the required similarity holds so many of an item's shingles
    that it can miss at most `free` of them; `free` + 1 are keys.
    """

    def __init__(self, shingle: int, numbers: list[int], counts: list[tuple], similarity: float):
        self.shingle = shingle
        every, rows = np.unique(np.concatenate([c[0] for c in counts]), return_counts=True)
        keys, items = [], []
        for number, (values, many) in zip(numbers, counts):
            order = np.lexsort((values, rows[np.searchsorted(every, values)]))
            total = int(many.sum())
            free = total - math.ceil(similarity * total - 1e-9)
            n = int(np.searchsorted(np.cumsum(many[order]), free + 1)) + 1
            keys.append(values[order[:n]])
            items.append(np.full(len(keys[-1]), number, np.int64))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.items = items[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.mask = np.uint64((1 << min(26, max(12, len(self.keys).bit_length() + 4))) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(self.keys & self.mask).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and the items that they are keys of."""
        at = np.flatnonzero(np.take(self.maybe, (h & self.mask).astype(np.int64)))
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[key] == h[at]
        at, key = at[same], key[same]
        many = self.first[key + 1] - self.first[key]
        return np.repeat(at, many), self.items[np.repeat(self.first[key], many) + ranges(many)]


class Index:
    """A bounded set of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids, self.counts, classes, lengths = [], [], {}, {}
        words, first = words_of(pa.array([t for _, t in items], pa.string()))
        for r, (item, _) in enumerate(items):
            own = words[first[r] : first[r + 1]]
            n = len(own)
            if not n:
                continue
            k = min(SHINGLE_WORDS, n)
            shingles = windows(own, k)
            values, counts = np.unique(shingles, return_counts=True)
            number = len(self.ids)
            self.ids.append(item)
            self.counts.append((values, counts))
            lengths.setdefault(k, []).append(number)
            size = size_class(n)
            group = classes.setdefault((size, k), Class(size, k))
            prints = simhash(lanes(shingles), group.size)
            least = 2 * similarity / (1 + similarity) * len(shingles) - 1e-9
            group.bound = min(group.bound, least - len(shingles) + group.size)
            starts = {*range(0, n - size + 1, size), n - size}
            for s in sorted(starts):
                group.prints.append(int(prints[s]))
                group.items.append((number, s))
        self.known = np.zeros(int(KNOWN_BITS) + 1, bool)
        for values, _ in self.counts:
            self.known[(values & KNOWN_BITS).astype(np.int64)] = True
        self.classes = [classes[c] for c in sorted(classes)]
        for c in self.classes:
            c.close()
        self.totals = np.array([int(counts.sum()) for _, counts in self.counts], np.int64)
        self.keys = [
            Keys(k, numbers, [self.counts[i] for i in numbers], similarity)
            for k, numbers in sorted(lengths.items())
        ]

    def best_window(self, item: int, h: np.ndarray, begin: int, end: int, low: int, high: int):
        """(similarity, first shingle, shingles) of the best window that meets low..high.

        `begin` and `end` bound the row's shingles. A window has as many
        shingles as the item; at an end of the row, those that the row has.
        """
        values, counts = self.counts[item]
        size = int(self.totals[item])
        a, b = max(begin, low - size + 1), min(end, high + size)
        own = h[a:b]
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        place = np.flatnonzero(values[at] == own)
        which = at[place]
        order = np.argsort(which, kind="stable")
        which, place = which[order], place[order]
        # an occurrence counts if the window has fewer before it than the item has in all
        before = np.arange(len(place)) - counts[which]
        full = (before >= 0) & (which[np.maximum(before, 0)] == which)
        since = np.where(full, place[np.maximum(before, 0)] + 1, place - size + 1)
        since = np.maximum(since, place - size + 1)
        steps = np.zeros(b - a + size + 1, np.int64)  # by the window's start, from a - size + 1
        np.add.at(steps, since + size - 1, 1)
        np.add.at(steps, place + size, -1)
        starts = np.arange(low - size + 1 - a, high + 1 - a)
        shared = np.cumsum(steps)[starts + size - 1]
        lengths = np.minimum(b - a, starts + size) - np.maximum(starts, 0)
        value = shared / (lengths + size - shared)
        best = int(np.argmax(value))
        return float(value[best]), a + max(0, int(starts[best])), int(lengths[best])

    def scan(self, words: np.ndarray, first: np.ndarray) -> list[tuple]:
        """(row, item, similarity, first word, words) of the best window of each row and item."""
        best: dict[tuple[int, int], tuple] = {}
        for keys in self.keys:
            k = keys.shingle
            h = windows(words, k)
            if not len(h):
                continue
            places, items = (list(x) for x in zip(keys.hits(h)))
            known = np.zeros(len(h) + 1, np.int64)
            np.cumsum(self.known[(h & KNOWN_BITS).astype(np.int64)], out=known[1:])
            sums = lanes(h)
            for group in self.classes:
                if group.shingle != k or len(h) < group.size:
                    continue
                where, which = group.candidates(simhash(sums, group.size), known)
                places.append(where)
                items.append(group.numbers[which])
            place, item = np.concatenate(places), np.concatenate(items)
            row = np.searchsorted(first, place, side="right") - 1
            inside = place + k <= first[row + 1]
            place, item, row = place[inside], item[inside], row[inside]
            order = np.lexsort((place, item))
            place, item, row = place[order], item[order], row[order]
            # places so near that a window can meet both are looked at together
            cut = np.diff(item, prepend=-1) != 0
            cut |= np.diff(row, prepend=-1) != 0
            cut[1:] |= np.diff(place) >= 2 * self.totals[item[1:]]
            begins = np.flatnonzero(cut)
            ends = np.append(begins[1:], len(place)) - 1
            for x, y in zip(begins.tolist(), ends.tolist()):
                r, i = int(row[x]), int(item[x])
                begin, end = int(first[r]), int(first[r + 1]) - k + 1
                value, at, n = self.best_window(i, h, begin, end, int(place[x]), int(place[y]))
                if value >= self.similarity:
                    new = (-value, at - begin)
                    if (r, i) not in best or new < best[(r, i)][0]:
                        best[(r, i)] = (new, n + k - 1)
        return [
            (r, self.ids[i], -new[0], new[1], n) for (r, i), (new, n) in sorted(best.items())
        ]


def parts_of(benchmark: DataFrame) -> int:
    """How many parts of bounded size the benchmark is taken in."""
    chars = benchmark.where("text IS NOT NULL").agg(F.sum(F.length("text") + 50)).first()[0] or 0
    return math.ceil(chars / CHUNK_CHARS)


def indexes(benchmark: DataFrame, similarity: float, parts: int) -> Iterator[Index]:
    """The parts one after the other; each is held by the driver, then by every task of one pass."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(
        "text IS NOT NULL"
    )
    for part in range(parts):
        own = items
        if parts > 1:
            own = items.where(F.expr(f"pmod(xxhash64(text), {parts}) = {part}"))
        rows = sorted({(r[0], r[1]) for r in own.toLocalIterator()}, key=str)
        yield Index(rows, similarity)


def find_passages(
    documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY
) -> DataFrame:
    """Benchmark passages in documents: doc_id, item_id, similarity, first_word, n_words.

    One row for each document row and item of which some window of the item's
    size has a weighted shingle similarity of at least `similarity`: its best
    window, the first among equals. A window that reaches over an end of the
    row has the words that are in the row. Rows that repeat give repeated results; a
    null id stays null; null and empty texts have no words and no results, and
    items without words are never found. Items of fewer than five words count
    as one shingle. Other columns are not read. The whole benchmark is held by
    each task in parts of at most ``CHUNK_CHARS`` characters, with one pass
    over the documents for each part; the finds of one are written before the
    next is read. Texts of any length are read whole.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = parts_of(benchmark)
    found = []
    for index in indexes(benchmark, similarity, parts):
        rows = scan_documents(docs, index)
        found.append(rows if parts == 1 else stored(rows, "passages"))
    if not found:
        return spark.createDataFrame([], SCHEMA)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def scan_documents(docs: DataFrame, index: Index) -> DataFrame:
    def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        words, first = words_of(piece.column(1))
        hits = index.scan(words, first)
        if not hits:
            return None
        rows, items, values, at, n = zip(*hits)
        return pa.RecordBatch.from_arrays(
            [
                piece.column(0).take(pa.array(rows)),
                pa.array(items, pa.int64()),
                pa.array(values, pa.float64()),
                pa.array(at, pa.int64()),
                pa.array(n, pa.int64()),
            ],
            ["doc_id", "item_id", "similarity", "first_word", "n_words"],
        )

    return map_pieces(docs, work, SCHEMA)


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY
) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark passage."""
    out = documents
    at = documents.columns.index("text")
    parts = parts_of(benchmark)
    for index in indexes(benchmark, similarity, parts):

        def run(batches, index=index):
            for batch in batches:
                for piece in pieces(batch):
                    words, first = words_of(piece.column(at).cast(pa.string()))
                    keep = np.ones(piece.num_rows, bool)
                    keep[[hit[0] for hit in index.scan(words, first)]] = False
                    yield piece.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
        if parts > 1:
            out = stored(out, "clean")
    return out
