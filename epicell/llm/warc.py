"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary; each record is a frame of its
own, so it can be read from its offset with nothing but that dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.common import col
from epicell.session import settle, shared_dir

# fixed values of the formats: the skippable frame that holds a dictionary, the record version,
# the profile of a record that repeats a payload
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REPEATED = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 * 1024
# the dictionary is trained on about so many records of at most SAMPLE_RECORD_BYTES
SAMPLE_RECORDS = 500
SAMPLE_RECORD_BYTES = 64 * 1024
LEVEL = 3
ARCHIVE_BYTES = 256 * 1024 * 1024
READ_BYTES = 16 * 1024

MANIFEST = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("archive_bytes", T.LongType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

_ID_HEAD = 0x57415243_00008000  # version 8: the content of the identifier is the application's own


def record_id(page_id: int | None) -> str:
    """An identifier that holds the page; a page without an id gets a random one."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    bits = page_id & (2**64 - 1)
    value = (_ID_HEAD | bits >> 62) << 64 | 1 << 63 | bits & (2**62 - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(identifier: str | None) -> int | None:
    if identifier is None:
        return None
    value = uuid.UUID(identifier[len("<urn:uuid:") : -1]).int
    if value >> 66 != _ID_HEAD >> 2:
        return None
    bits = (value >> 64 & 3) << 62 | value & (2**62 - 1)
    return bits - 2**64 if bits >> 63 else bits


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REPEATED}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, object]:
    """A row of RECORDS. The digest and the length are those of the full payload, also in a revisit."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    payload = block[cut + 4 :]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    response = head["WARC-Type"] == "response"
    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    return {
        "record_type": head["WARC-Type"],
        "page_id": page_of(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "payload_digest": digest,
        "payload_bytes": length,
        "refers_to": page_of(head.get("WARC-Refers-To")),
        "payload": payload if response else None,
    }


class ArchiveWriter:
    """One archive file; `folder` may be a path or a URI that pyarrow can open."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.name, self.records, self.size = name, 0, 0
        self.out = system.open_output_stream(posixpath.join(path, name), compression=None)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        if dictionary:
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._write(self.compressor.compress(record))
        self.records += 1

    def close(self) -> dict[str, object]:
        self.out.close()
        return {"archive": self.name, "records": self.records, "archive_bytes": self.size}


def read_archive(folder: str, name: str) -> Iterator[bytes]:
    """The records of one archive, frame by frame; memory holds one record at a time."""
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    with system.open_input_stream(posixpath.join(path, name), compression=None, buffer_size=1 << 20) as stream:
        rest = stream.read(8)
        shared = None
        if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == DICTIONARY_MAGIC:
            shared = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", rest[4:])[0]))
            rest = b""
        reader = zstandard.ZstdDecompressor(dict_data=shared)
        while rest := rest or stream.read(READ_BYTES):
            frame, parts = reader.decompressobj(), []
            while not frame.eof:
                data = rest or stream.read(READ_BYTES)
                if not data:
                    raise ValueError(f"{name} ends inside a record")
                parts.append(frame.decompress(data))
                rest = frame.unused_data if frame.eof else b""
            yield b"".join(parts)


def repeated_payloads(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Every page with `digest` (hexadecimal SHA-1) and `first_id`, the page that keeps the payload.

    A digest that occurs once has no row in the joined table, so that table holds repeated
    payloads only. The counts are partial sums, and written: both sides of the join are then bare shuffles, so
    the runtime splits a payload that is a third of all rows, and every page meets one row at most.
    """
    body = F.coalesce(col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(col(key).cast("long").alias("page_id"), body.alias("body"), F.sha1(body).alias("digest"), *_url(pages, key, payload))
    kept = rows.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(settle(kept.where("copies > 1").drop("copies"), "payloads"), "digest", "left")


def _url(pages: DataFrame, key: str, payload: str) -> list:
    return [col("url").cast("string").alias("url") if "url" in pages.columns and "url" not in (key, payload) else F.lit(None).cast("string").alias("url")]


def train_dictionary(pages: DataFrame, key: str, payload: str, date: str) -> bytes:
    """A dictionary trained on a bounded sample of the records that will be archived.

    About SAMPLE_RECORDS pages, twice that at most, evenly by a hash of the key. With too few or too
    uniform records there is none, and the archives then have no leading frame.
    """
    fit = pages.where(F.length(col(payload)) <= SAMPLE_RECORD_BYTES)
    n = fit.count()
    if not n:
        return b""
    part = F.pmod(F.xxhash64(col(key)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_RECORDS / n)) + 1
    rows = fit.where(part).select(col(key).cast("long"), col(payload).cast("string"), *_url(pages, key, payload)).limit(2 * SAMPLE_RECORDS).collect()
    samples = []
    for page_id, text, url in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        body = text.encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        samples.append(build_record(page_id, url, body, digest, None, False, date))
    for size in (DICTIONARY_BYTES, DICTIONARY_BYTES // 4, DICTIONARY_BYTES // 16, DICTIONARY_BYTES // 64):
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too little in the samples for one of this size
            continue
    return b""


def write_archives(
    pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", payload: str = "html"
) -> DataFrame:
    """Write every page as a record into archives under `folder`; gives (archive, records, archive_bytes).

    `folder` must be shared by all executors. Of pages with equal payloads the one with the
    largest key becomes a response and the others revisits of it; pages that share that largest
    key are all responses. A NULL payload counts as an empty one, and empty payloads are equal. A
    page with a NULL key never keeps a payload that a page with a key has. A column `url` is used if there; others are
    ignored. An empty table gives no archive.

    Each task writes own files, named by its attempt, and hands out their names: the manifest
    lists only what succeeding attempts wrote, so a lost executor leaves unlisted files and
    no double records.
    """
    dictionary = train_dictionary(pages, key, payload, date)
    rows = repeated_payloads(pages, key, payload)
    arrow = to_arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer, files, done = None, 0, []
        for batch in batches:
            for page_id, body, hexed, url, first in zip(*[batch.column(i) for i in range(5)]):
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:03d}.warc.zst"
                    writer, files = ArchiveWriter(folder, name, dictionary), files + 1
                digest = base64.b32encode(bytes.fromhex(hexed.as_py())).decode()
                page, target = page_id.as_py(), first.as_py()
                revisit = target is not None and page != target
                writer.add(build_record(page, url.as_py(), body.as_py(), digest, target, revisit, date))
                if writer.size >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    source = rows.select("page_id", "body", "digest", "url", "first_id")
    return settle(source.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of all archives of a manifest, as rows of RECORDS. An empty manifest gives none; a page whose
    payload was NULL or empty comes back as an empty payload, a NULL page_id as NULL."""
    arrow = to_arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for record in read_archive(folder, name):
                    rows.append(parse_record(record))
                    size += len(record)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    archives = manifest.select("archive")
    return archives.repartition(max(1, archives.count())).mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to a fresh folder under the shared one, and read them back: one record per row, repeated and
    NULL ids included. NULL payloads are empty ones; without any page there is no record."""
    folder = shared_dir(spark, "warc")
    return read_archives(write_archives(pages, folder), folder)
