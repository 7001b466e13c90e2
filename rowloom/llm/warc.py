"""WARC archives in seekable Zstandard bundles.

Records are gathered into independent frames of about ``FRAME_BYTES``. Two
skippable frames end a bundle: a map of records (identifier, frame, offset in
the frame) and the seek table of the public seekable format, so that any
record is read with its frame alone, and any Zstandard reader can unpack the
bundle into a plain WARC file.

Of pages with equal payloads one is stored, others are revisit records.
"""

from __future__ import annotations

import struct
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import pieces, shared_files, stored, write_file
from rowloom.session import work_folder

FRAME_BYTES = 1 << 18
LEVEL = 3
LEAST_BYTES = 1000  # smaller payloads are always stored

# Fixed values of the Zstandard seekable format and of WARC 1.1.
SEEK_FRAME = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
MAP_FRAME = 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = np.dtype([("id", "<i8"), ("null", "<u4"), ("frame", "<u4"), ("offset", "<u4")])


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, original: the page that a page revisits, or null.

    Payloads are compared by their SHA-1. The largest id of equal payloads of
    at least ``LEAST_BYTES`` is found by a grouping that combines map-side; its
    result is written before it is joined, so that a payload of very many
    pages is a skewed key of a plain join, which Spark splits.
    """
    rows = pages.selectExpr(
        "cast(page_id AS bigint) AS page_id",
        "cast(url AS string) AS url",
        "coalesce(cast(html AS string), '') AS html",
        "sha1(encode(coalesce(cast(html AS string), ''), 'UTF-8')) AS digest",
    )
    largest = (
        rows.where(F.octet_length("html") >= LEAST_BYTES)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("largest"))
        .where("n > 1 AND largest IS NOT NULL")
        .select("digest", "largest")
    )
    return rows.join(stored(largest, "warc-copies"), "digest", "left").selectExpr(
        "page_id",
        "url",
        "html",
        "digest",
        "CASE WHEN NOT page_id <=> largest THEN largest END AS original",
    )


def record(page_id, url, payload: bytes, digest: str, original) -> bytes:
    """One WARC record; a revisit holds the head of the response alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if original is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if original is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{original}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = "!#$%&'()*+,/:;=?@[]~-._"  # of an address; other characters are percent-encoded


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields of the record and of its response, and the payload."""
    head, _, _ = raw[at:].partition(b"\r\n\r\n") if at else raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    begin = at + len(head) + 4
    block = raw[begin : begin + int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    answer = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return fields, answer, payload


def page_of(urn: str | None) -> int | None:
    name = (urn or "null").strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def bundle(records, ids: list) -> object:
    """The bytes of a bundle, part by part; ids is filled as records are drawn."""
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    seek, places, room = [], [], bytearray()

    def frame() -> bytes:
        out = compressor.compress(bytes(room))
        seek.append((len(out), len(room)))
        room.clear()
        return out

    for page_id, raw in records:
        places.append((page_id or 0, page_id is None, len(seek), len(room)))
        ids.append(page_id)
        room += raw
        if len(room) >= FRAME_BYTES:
            yield frame()
    if room:
        yield frame()
    table = np.array(places, ENTRY).tobytes()
    yield struct.pack("<II", MAP_FRAME, len(table)) + table
    entries = b"".join(struct.pack("<II", *s) for s in seek)
    entries += struct.pack("<IBI", len(seek), 0, SEEK_MAGIC)
    yield struct.pack("<II", SEEK_FRAME, len(entries)) + entries


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write a bundle for each partition of the pages; returns name and records of each."""
    system, place = shared_files(folder)
    system.create_dir(place, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        ids: list = []

        def records():
            for batch in batches:
                for piece in pieces(batch, "html"):
                    for p, u, h, d, o in zip(*(c.to_pylist() for c in piece.columns)):
                        yield p, record(p, u, h.encode(), d, o)

        to, at = shared_files(folder)
        write_file(to, f"{at}/{name}", bundle(records(), ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([len(ids)], pa.int64())], ["name", "records"]
        )

    return with_originals(pages).mapInArrow(run, "name string, records long")


class Bundle:
    """A bundle, open for reading single records."""

    def __init__(self, folder: str, name: str):
        import zstandard

        system, place = shared_files(folder)
        self.file = system.open_input_file(f"{place}/{name}")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.sizes = np.frombuffer(table, "<u4").reshape(-1, 2).astype(np.int64)
        self.ends = np.cumsum(self.sizes[:, 0])
        at = int(self.ends[-1]) if n else 0
        magic, length = struct.unpack("<II", self.file.read_at(8, at))
        if magic != MAP_FRAME:
            raise ValueError(f"{name} has no record map")
        self.places = np.frombuffer(self.file.read_at(length, at + 8), ENTRY)
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        length, full = self.sizes[i].tolist()
        raw = self.file.read_at(length, int(self.ends[i]) - length)
        return self.unpack.decompress(raw, max_output_size=full)

    def lookup(self, page_id: int):
        """The record of a page: its fields, the response's fields and the payload."""
        own = np.flatnonzero((self.places["id"] == page_id) & (self.places["null"] == 0))
        if not len(own):
            return None
        place = self.places[own[0]]
        return parse(self.frame(int(place["frame"])), int(place["offset"]))

    def __iter__(self):
        order = np.searchsorted(self.places["frame"], np.arange(len(self.sizes) + 1))
        for i, (a, b) in enumerate(zip(order, order[1:])):
            raw = self.frame(i)
            ends = [*self.places["offset"][a + 1 : b].tolist(), len(raw)]
            for begin, end in zip(self.places["offset"][a:b].tolist(), ends):
                yield parse(raw[begin:end])


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def read_bundles(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for fields, answer, _ in Bundle(folder, name):
                    rows.append(
                        (
                            page_of(fields["WARC-Record-ID"]),
                            int(answer["Content-Length"]),
                            fields["WARC-Payload-Digest"].partition(":")[2],
                            fields["WARC-Type"],
                            page_of(fields.get("WARC-Refers-To")),
                        )
                    )
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    count = names.count()
    return names.select("name").repartition(max(1, count)).mapInArrow(run, READ)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], COLUMNS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write archives of the pages to a shared folder and read them back.

    One record for each row; a null html is an empty payload, a null url has no
    address. Of equal payloads of at least ``LEAST_BYTES`` bytes the pages with
    the largest id are responses (all rows, if they repeat it), others revisit
    it; a null id is never the largest and stays null. Other columns are not
    read.
    """
    spark = pages.sparkSession
    folder = work_folder(spark, "warc")
    names = stored(write_bundles(pages, folder), "warc-names")
    return read_bundles(spark, folder, names)
