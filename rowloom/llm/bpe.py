"""Byte-level BPE with a local rank file, forth and back.

The tiktoken library does the merges. It is given the rank file and the
splitting pattern; nothing is downloaded. Long texts are cut where the pattern
can't match across: between a word character and a blank or line break, as no
alternative of the pattern goes on from one to the other. Ids of the parts are
those of the whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import map_pieces

PART_CHARS = 1 << 16
SAFE = re.compile(r"\w(?=[ \n])")


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    """The tokenizer of a rank file, built once for each Python worker."""
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


@lru_cache(maxsize=2)
def decimals(n: int) -> list[bytes]:
    return [str(i).encode() for i in range(n)]


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text cut at safe boundaries into parts of about `size` characters."""
    if len(text) <= size:
        return [text]
    out, begin = [], 0
    while len(text) - begin > size:
        cut = SAFE.search(text, begin + size)
        if not cut:
            break
        out.append(text[begin : cut.end()])
        begin = cut.end()
    out.append(text[begin:])
    return out


def encode(enc, text: str) -> list[int]:
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in parts(text):
        ids += enc.encode_ordinary(part)
    return ids


def encode_texts(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the ids of every text (null or empty: none).

    Every row gives a row; repeated rows, null ids and texts of any length are
    encoded like all others. Other columns are not read.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks, pattern)
        ids = [encode(enc, t or "") for t in piece.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
        )

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_pieces(docs, work, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary: the bytes that the ids of each row stand for (null: empty)."""

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    Encodes each text, decodes its ids again, and keeps digests of the decimal
    ids, joined by commas, and of the decoded bytes. Edge cases as in
    `encode_texts`; the digest of an empty text is that of no bytes.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks, pattern)
        names = decimals(enc.max_token_value + 1)
        n, of_ids, of_bytes = [], [], []
        for text in piece.column(1).to_pylist():
            ids = encode(enc, text or "")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(b",".join([names[i] for i in ids])).hexdigest())
            of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_pieces(docs, work, DIGEST)
