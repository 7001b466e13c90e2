"""Helpers shared by the text operators: words, hashes, shingles, shared files.

Texts reach Python as Arrow batches. All words of a batch are found and hashed
by whole-array operations on its UTF-8 bytes; a batch is cut into pieces of
about ``PIECE_BYTES`` first, so that memory follows the piece or, if it is
longer, the longest single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from rowloom.session import work_folder

PIECE_BYTES = 1 << 20
SHINGLE_WORDS = 5
SIMILARITY = 0.8

ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bytes(lower: bool) -> np.ndarray:
    """Which bytes belong to words: 0-9, a-z, everything beyond ASCII, and A-Z if lowered."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    table[0x41:0x5B] = lower
    return table


WORDS = word_bytes(lower=True)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
TOKENS = ~SPACES


@lru_cache(maxsize=4)
def byte_codes(lower: bool) -> np.ndarray:
    """A fixed 64-bit code for every byte, the same for A-Z and a-z if lowered."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    base = 0xD6E8FEB86659FD93
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", cls.base), ("down", pow(cls.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def find_words(raw: np.ndarray, at: np.ndarray, members: np.ndarray):
    """Starts and ends of all words in bytes, and the index of each row's first word."""
    inside = members[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < len(raw)]
    start[rows] = inside[rows]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    stop[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of every span of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = Powers.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_codes(lower)[raw] * up[: len(raw)], out=sums[1:])
    spans = (sums[ends] - sums[starts]) * down[starts]
    return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(ODD))


def words_of(column: pa.Array, members: np.ndarray = WORDS, lower: bool = True):
    """Hashes of all words of the rows, and the index of each row's first word."""
    raw, at = text_bytes(column)
    starts, ends, first = find_words(raw, at, members)
    return hash_spans(raw, starts, ends, lower), first


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words; runs across rows are to be left out by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xA0761D6478BD642F)
        out += words[j : n + j]
    return mix(out)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count, one after the other."""
    total = int(counts.sum())
    begins = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begins, counts)


def row_shingles(words: np.ndarray, first: np.ndarray, k: int = SHINGLE_WORDS):
    """Hashes of the k-word shingles of every row, and how many each row has.

    A row of fewer than k words, but not none, has its whole word sequence as
    its one shingle.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, 0)
    at = np.repeat(first[:-1], counts) + ranges(counts)
    every = windows(words, k)
    out = every[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array(
            [windows(words[first[r] : first[r + 1]], int(n[r]))[0] for r in short], np.uint64
        )
        where = np.cumsum(counts)[short]
        out = np.insert(out, where, extra)
        counts = counts.copy()
        counts[short] = 1
    return out, counts


def pieces(
    batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_pieces(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text="text"
) -> DataFrame:
    """Apply a function to every piece of the rows, as Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_files(folder: str):
    """A file system and path for a folder that driver and executors share."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_file(system, path: str, parts) -> int:
    """Write under a temporary name and move into place, so that retries replace whole files."""
    import uuid

    temporary, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with system.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(temporary, path)
    return size
