"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records, and a
skippable frame at its end with the frames' sizes (the seekable format's seek table).
The index maps a record to its bundle, its frame and its place in the frame, so that a
record is read by decompressing one frame. Each task writes bundles of bounded size under a
name of its own in the shared folder; the index, a Parquet table, names the files
of tasks that ended well, so a lost or repeated task leaves at most an unused file.

Records of equal payload (of some least size) are told apart by page_id: the largest is the
response, the others are revisit records that refer to it and hold no payload.

The join back to the pages carries one row a repeated payload; a payload that a third
of all pages share is split by Spark's skew join.

Defined cases: a null html is an empty payload; a null page_id is smaller than any other and
is never referred to unless all of a payload's ids are null, when all of them are
responses; rows that repeat the largest id are all responses; a null url has no target
header; line ends in a url are percent-encoded; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import bounded_batches, fresh_path, stored

FRAME_BYTES, BUNDLE_BYTES = 256 * 1024, 128 * 1024 * 1024
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_URN = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame long, at long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str = "1970-01-01T00:00:00Z") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").removeprefix(_URN)) else None
    if fields["warc-type"] == "response":
        made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != sizes[0] or fields["warc-payload-digest"] != f"sha1:{made}":
            raise ValueError(f"the payload of {fields['warc-record-id']} isn't what its headers say")
    return {
        "page_id": number("warc-record-id"), "payload_bytes": sizes[0], "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": fields["warc-type"],
        "refers_to": number("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload": payload if fields["warc-type"] == "response" else None,
    }


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """sizes: compressed and plain bytes of each frame."""
    entries = b"".join(struct.pack("<II", *of) for of in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int]]:
    """Offset and compressed size of each frame of an open bundle."""
    end = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entries = file.read_at(8 * n, end - 9 - 8 * n)
    out, at = [], 0
    for compressed, _ in struct.iter_unpack("<II", entries):
        out.append((at, compressed))
        at += compressed
    return out


class BundleWriter:
    """Writes bundles to folder; rows() gives the index rows of what is in closed frames."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int) -> None:
        self._fs, self._folder = pa.fs.FileSystem.from_uri(folder)
        self._fs.create_dir(self._folder)
        self._uri, self._frame_bytes, self._bundle_bytes = folder, frame_bytes, bundle_bytes
        self._zstd = zstandard.ZstdCompressor(level=3)
        self._file = None
        self._rows: list[tuple] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        if self._file is None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            self._file, self._bundle, self._sizes, self._written = self._fs.open_output_stream(f"{self._folder}/{name}", compression=None), f"{self._uri}/{name}", [], 0
            self._frame = bytearray()
        self._rows.append((page_id, self._bundle, len(self._sizes), len(self._frame), len(record)))
        self._frame += record
        if len(self._frame) >= self._frame_bytes:
            self._end_frame()
            if self._written >= self._bundle_bytes:
                self.close()

    def _end_frame(self) -> None:
        made = self._zstd.compress(bytes(self._frame))
        self._file.write(made)
        self._sizes.append((len(made), len(self._frame)))
        self._written += len(made)
        self._frame = bytearray()

    def close(self) -> None:
        if self._file is not None:
            if self._frame:
                self._end_frame()
            self._file.write(seek_table(self._sizes))
            self._file.close()
            self._file = None

    def rows(self) -> list[tuple]:
        rows, self._rows = self._rows, []
        return rows


class BundleReader:
    """Keeps the last bundle open and its last frame decompressed."""

    def __init__(self) -> None:
        self._bundle = self._frame = None

    def record(self, bundle: str, frame: int, at: int, length: int) -> bytes:
        if bundle != self._bundle:
            fs, path = pa.fs.FileSystem.from_uri(bundle)
            self._file, self._bundle, self._frame = fs.open_input_file(path), bundle, None
            self._frames = read_seek_table(self._file)
        if frame != self._frame:
            offset, size = self._frames[frame]
            self._plain, self._frame = zstandard.ZstdDecompressor().decompress(self._file.read_at(size, offset)), frame
        return self._plain[at : at + length]


def with_referrals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null: a response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    repeated = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "largest")
    joined = rows.join(repeated, "digest", "left")
    refers = F.when(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record for each page; returns the index (see INDEX), a stored table."""
    bounded_batches(pages.sparkSession)
    folder = fresh_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles = BundleWriter(folder, frame_bytes, bundle_bytes)

        def told() -> pa.RecordBatch:
            columns = list(zip(*bundles.rows(), strict=True)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "bundle", "frame", "at", "length"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                bundles.add(page_id, warc_record(page_id, url, payload, refers_to, digest))
            yield told()
        bundles.close()
        yield told()

    return stored(with_referrals(pages, min_bytes).mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records (see RECORDS) that index points to, in its order, so each frame is decompressed once."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 6 + with_payload]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles = BundleReader()
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = [parse_record(bundles.record(*of)) for of in zip(*(c.to_pylist() for c in batch.slice(part, 1000).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=False)], names=names)

    return index.select("bundle", "frame", "at", "length").mapInArrow(read, RECORDS if with_payload else RECORDS.rpartition(",")[0])
