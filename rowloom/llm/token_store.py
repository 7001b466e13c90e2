"""Token ids in files: each document compressed by itself with a shared dictionary.

A file is: the magic and version, the SHA-256 of the dictionary, one Zstandard
frame for each document, an index (for each document its id, and where its
frame ends and how many ids come before it, all 64-bit little-endian), and a
footer with the number of documents and the place of the index. Ids are 16-bit
where the vocabulary allows it, else 32-bit. The dictionary is trained on the
serialized ids of a bounded sample of documents and lies beside the files. A
short document is read by its index entry and its frame alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain, groupby
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import pieces, shared_files, stored, write_file
from rowloom.llm.merge_automaton import LATIN_LETTERS, LATIN_NUMBERS, has_usual_rules
from rowloom.session import work_folder

MAGIC = b"TOKZ\x01"
SAMPLE = 2_000  # documents that the dictionary is trained on, at most
SAMPLE_IDS = 4_000  # ids of each of them, at most
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
CACHE = 800_000  # words whose ids a worker remembers, and those of one piece more
LEARN = 20_000  # new words that are encoded in one call
JOINED = 4_000  # words of Latin letters that are encoded as one text
LONG = 1 << 20  # characters of a text, beyond which its words don't become objects all at once
BYTES = 4 << 20  # bytes of text whose distinct words are looked up together
HEAD = len(MAGIC) + 32
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("end", "<i8"), ("before", "<i8")])
FOOTER = "<qqq"  # documents, ids, place of the index


# Texts of visible characters below U+0100 and ASCII blanks, and the words that the usual rules cut them into.
LATIN_TEXT = re.compile("[ \t-\r!-~\xa1-\xff]*")
LATIN_TEXT_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^ \t-\r{LATIN_LETTERS}{LATIN_NUMBERS}]+"
)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


class Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        self.new.append(text)
        self[text] = number = len(self)
        return number

    def take_new(self) -> list[str]:
        """The strings numbered since the last call."""
        new, self.new = self.new, []
        return new


class Encoder:
    """Ids of texts by way of their words.

    The tokenizer drops white space, so that the ids of a text are those of its
    words one after the other; each distinct word is encoded once, many as one
    text, where it is known how the tokenizer cuts, else each string between
    blanks. Texts with a string of a special token are encoded whole, as such
    strings may have blanks and are matched before words are.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        end = plan["model"].get("end_of_word_suffix")
        self.usual = bool(end) and has_usual_rules(plan)
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 + max(names.values(), default=0), np.int64)
        if self.usual:
            self.ends_word[[i for name, i in names.items() if name.endswith(end)]] = 1
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)  # the ids of all known words
        self.ends = np.zeros(1, np.int64)
        self.words = Numbers()  # words of the tokenizer, and their ids
        self.word_ids = np.zeros(0, np.uint32)
        self.word_ends = np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in found]

    def learn(self, strings: list[str]) -> None:
        """Encode strings that aren't known yet."""
        for i in range(0, len(strings), LEARN):
            part = strings[i : i + LEARN]
            lists = self.whole(part)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))

    def learn_words(self, words: list[str]) -> bool:
        """Encode new words of the tokenizer; False if they turn out to be others."""
        ids, ends = [self.word_ids], [self.word_ends]
        total = int(self.word_ends[-1])
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            own = np.array(self.whole([" ".join(part)])[0], np.uint32)
            last = np.flatnonzero(self.ends_word[own])
            if len(last) != len(part):
                return False
            ids.append(own)
            ends.append(last + 1 + total)
            total += len(own)
        self.word_ids, self.word_ends = np.concatenate(ids), np.concatenate(ends)
        return True

    def latin(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """`encode` for texts of Latin letters and blanks, cut into the tokenizer's words here.

        Only words that no text had before are encoded. None if the cuts turn
        out to be others than the tokenizer's.
        """
        if len(self.words) > CACHE:
            self.forget()
        lists = [LATIN_TEXT_WORDS.findall(t.lower()) for t in texts]
        words = list(chain.from_iterable(lists))
        which = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if not self.learn_words(self.words.take_new()):
            self.forget()
            return None
        starts = self.word_ends[which]
        sizes = self.word_ends[which + 1] - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts - ends[:-1], sizes) + np.arange(int(ends[-1]))
        rows = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        return self.word_ids[at], np.diff(ends[rows], prepend=0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and how many each row has."""
        column = pc.fill_null(column, "")
        texts = column.to_pylist() if self.usual else []
        plain = [len(t) <= LONG and bool(LATIN_TEXT.fullmatch(t)) and not any(m in t for m in self.special) for t in texts]
        found = self.latin([t for t, p in zip(texts, plain) if p]) if any(plain) else None
        if found is None:
            return self.encode_strings(column)
        if all(plain):
            return found
        mask = np.array(plain)
        other = self.encode_strings(column.filter(pa.array(~mask)))
        counts = np.zeros(len(column), np.int64)
        counts[mask], counts[~mask] = found[1], other[1]
        values = np.zeros(int(counts.sum()), np.uint32)
        of_plain = np.repeat(mask, counts)
        values[of_plain], values[~of_plain] = found[0], other[0]
        return values, counts

    def encode_strings(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`encode` for texts of any kind, by the strings between blanks."""
        column = column.cast(pa.large_string())
        lists = pc.ascii_split_whitespace(column)
        coded = lists.values.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        new = [w for w in kinds if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.forget()
            new = kinds
        if new:
            self.learn(new)
        at_word = np.fromiter(map(self.known.__getitem__, kinds), np.int64, len(kinds))
        which = at_word[coded.indices.to_numpy(zero_copy_only=False)]
        starts = self.ends[which]
        n = self.ends[which + 1] - starts
        total = np.cumsum(n)
        at = np.repeat(starts - (total - n), n) + np.arange(int(n.sum()))
        ends = np.concatenate([[0], total])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        values, counts = self.flat[at], np.diff(ends)
        odd = np.zeros(len(column), bool)
        for mark in self.special:
            odd |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        if odd.any():
            rows = np.split(values, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd):
                rows[i] = np.array(self.whole([column[int(i)].as_py()])[0], np.uint32)
            values, counts = np.concatenate(rows), np.array([len(r) for r in rows])
        return values, counts


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One for each worker, so that its tasks share the known words."""
    return Encoder(path)


def train_dictionary(documents: DataFrame, path: str, end_id: int, wide: bool) -> bytes:
    """A dictionary from at most SAMPLE documents, chosen by a hash of their ids."""
    import zstandard

    chosen = (
        documents.select("doc_id")
        .where("doc_id IS NOT NULL")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    rows = (
        documents.join(F.broadcast(chosen), "doc_id")
        .select(F.substring("text", 1, 4 * SAMPLE_IDS).alias("text"))
        .limit(2 * SAMPLE)
        .toPandas()
    )
    kind = "<u4" if wide else "<u2"
    values, counts = encoder_of(path).encode(pa.array(rows["text"], pa.string()))
    parts = np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []
    samples = [np.append(p[:SAMPLE_IDS], end_id).astype(kind).tobytes() for p in parts]
    samples = [s for s in samples if len(s) >= 8]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return b""  # too little to train on: frames need no dictionary
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def codec(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    shared = zstandard.ZstdCompressionDict(dictionary)
    return (
        zstandard.ZstdCompressor(level=LEVEL, dict_data=shared),
        zstandard.ZstdDecompressor(dict_data=shared),
    )


def part_of(documents: DataFrame, parts: int):
    """The number of the file that a doc_id belongs to: disjoint ranges, null first.

    The ends of the ranges are read off a range partitioning of the ids alone.
    """
    ends = (
        documents.select("doc_id")
        .where("doc_id IS NOT NULL")
        .repartitionByRange(parts, "doc_id")
        .groupBy(F.spark_partition_id())
        .agg(F.max("doc_id").alias("end"))
        .select("end")
    )
    ends = sorted(r["end"] for r in ends.collect())[:-1]
    if not ends:
        return F.lit(0)
    # In two steps, the ends in groups: about twice the root of their number is compared.
    step = isqrt(len(ends)) + 1
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]

    def listed(values) -> str:
        return f"array({', '.join(f'{e}L' for e in values)})"

    def under(values: str) -> str:
        return f"coalesce(size(filter({values}, e -> e < doc_id)), 0)"

    group = under(listed(g[-1] for g in groups))
    inner = f"array({', '.join(map(listed, groups))}, CAST(array() AS ARRAY<BIGINT>))"
    place = f"{group} * {step} + {under(f'element_at({inner}, {group} + 1)')}"
    return F.expr(f"least({place}, {len(ends)})").cast("int")


def encode_frames(documents: DataFrame, path: str, dictionary: bytes, end_id: int, wide: bool):
    """doc_id, n_ids and the compressed frame of every row."""

    def run(batches):
        encoder, (compressor, _) = encoder_of(path), codec(dictionary)
        kind = "<u4" if wide else "<u2"
        for batch in batches:
            for piece in pieces(batch, size=BYTES):
                values, counts = encoder.encode(piece.column(1))
                ends = np.cumsum(counts)
                values = np.insert(values, ends, end_id).astype(kind)
                begins = ends - counts + np.arange(len(counts))
                frames = [
                    compressor.compress(values[a : a + n].tobytes())
                    for a, n in zip(begins.tolist(), (counts + 1).tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(counts + 1), pa.array(frames, pa.binary())],
                    ["doc_id", "n_ids", "frame"],
                )

    return documents.mapInArrow(run, "doc_id long, n_ids long, frame binary")


def write_tokens(documents: DataFrame, path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all texts in ascending order of doc_id; returns the list of files.

    Texts are encoded and compressed where they are read; only the frames are
    shuffled, into files of disjoint ranges of doc_id (null ids come first,
    rows that repeat an id by their frames). A file is named by the number of
    its range, so that a task that is run again writes the same file. A null or
    empty text has the end id alone. Returns part, n_docs, n_ids.
    """
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wide = tokenizer(path).get_vocab_size() > 1 << 16
    dictionary = train_dictionary(documents, path, end_id, wide)
    system, place = shared_files(folder)
    system.create_dir(place, recursive=True)
    write_file(system, f"{place}/dictionary", [dictionary])
    digest = hashlib.sha256(dictionary).digest()
    write_file(
        system,
        f"{place}/about.json",
        [json.dumps({"wide": wide, "dictionary_sha256": digest.hex()}).encode()],
    )
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        encode_frames(documents, path, dictionary, end_id, wide)
        .withColumn("part", part_of(documents, parts))
        .repartition(parts, "part")
        .sortWithinPartitions("part", "doc_id", "frame")
        .select("part", "doc_id", "n_ids", "frame")
    )

    def run(batches):
        to, at = shared_files(folder)
        rows = (
            row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))
        )
        for part, own in groupby(rows, key=lambda r: r[0]):
            index, total = [], 0

            def frames(own=own):
                nonlocal total
                end = HEAD
                yield MAGIC + digest
                for _, i, n, frame in own:
                    end += len(frame)
                    index.append((i or 0, i is None, end, total))
                    total += n
                    yield frame
                yield np.array(index, ENTRY).tobytes()
                yield struct.pack(FOOTER, len(index), total, end)

            write_file(to, f"{at}/part-{part:06d}.tok", frames())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in (part, len(index), total)],
                ["part", "n_docs", "n_ids"],
            )

    return ordered.mapInArrow(run, "part long, n_docs long, n_ids long")


class TokenFile:
    """One file, open for reading single documents."""

    def __init__(self, folder: str, part: int, dictionary: bytes | None = None):
        self.system, place = shared_files(folder)
        if dictionary is None:
            with self.system.open_input_stream(f"{place}/dictionary") as f:
                dictionary = f.read()
        self.file = self.system.open_input_file(f"{place}/part-{part:06d}.tok")
        size = self.file.size()
        head = self.file.read_at(HEAD, 0)
        if head != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or one of another dictionary")
        n, self.n_ids, at = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        raw = self.file.read_at(n * ENTRY.itemsize, at)
        self.index = np.frombuffer(raw, ENTRY)
        self.decompressor = codec(dictionary)[1]

    def ids(self, i: int, kind: str = "<u2") -> np.ndarray:
        begin = HEAD if i == 0 else int(self.index["end"][i - 1])
        frame = self.file.read_at(int(self.index["end"][i]) - begin, begin)
        return np.frombuffer(self.decompressor.decompress(frame), kind)

    def lookup(self, doc_id: int, kind: str = "<u2") -> np.ndarray | None:
        """The ids of a document, found by bisection in the sorted index."""
        known = self.index[self.index["null"] == 0]
        i = int(np.searchsorted(known["doc_id"], doc_id))
        if i == len(known) or known["doc_id"][i] != doc_id:
            return None
        return self.ids(i + len(self.index) - len(known), kind)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files.

    `files` has one row for each file; ids before a file are summed over these
    rows alone. Whole files are read front to back, frame by frame.
    """
    system, place = shared_files(folder)
    with system.open_input_stream(f"{place}/about.json") as f:
        kind = "<u4" if json.loads(f.read())["wide"] else "<u2"
    rows, before = [], 0
    for r in sorted(files.collect(), key=lambda r: r["part"]):
        rows.append((r["part"], before))
        before += r["n_ids"]

    def run(batches):
        for batch in batches:
            for part, base in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(folder, part)
                n, crc = [], []
                for i in range(len(file.index)):
                    ids = file.ids(i, kind)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                ids = pa.array(file.index["doc_id"], mask=file.index["null"] == 1)
                for a in range(0, len(n), 10_000):
                    b = a + 10_000
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids[a:b],
                            pa.array(base + file.index["before"][a:b]),
                            pa.array(n[a:b], pa.int64()),
                            pa.array(crc[a:b], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    listed = spark.createDataFrame(rows, "part long, base long")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, READ)


def store_and_read(documents: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the token files of the documents to a shared folder and read them back."""
    spark = documents.sparkSession
    folder = work_folder(spark, "tokens")
    files = stored(write_tokens(documents, path, folder, end_id), "token-files")
    return read_tokens(spark, folder, files)
