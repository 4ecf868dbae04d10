"""WARC archives of individually compressed records with a shared dictionary.

An archive begins with a skippable frame that holds a Zstandard dictionary made
from the archive's own records; every record after it is one Zstandard frame
compressed with that dictionary, so any record can be read by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches, col, partitions
from quayside.session import materialize, new_path

#: Payloads below this size are never replaced by a revisit.
REVISIT_BYTES = 1000
#: An archive is closed once it holds so much record text.
ARCHIVE_BYTES = 64 << 20
#: The dictionary and the records at hand that it is built from.
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20

#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str) -> str:
    """The address with controls and blanks escaped, so that it stays one header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page: dict, payload: bytes) -> bytes:
    """The uncompressed WARC record of a page; revisits carry only HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = page["refers_to"] is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page['id'] is None else page['id']}>",
        f"WARC-Date: {page['date']}",
    ]
    if page["url"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(page['url'])}")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{page['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    named = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    if len(block) != int(named["Content-Length"]) or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda uri: None if uri is None or uri == "<urn:page:none>" else int(uri[len("<urn:page:") : -1])
    kind = named["WARC-Type"]
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not match its digest")
    return {
        "id": page(named["WARC-Record-ID"]),
        "url": named.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page(named.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained from the records; raw record text where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArchiveWriter:
    """Writes one archive; records wait until there are enough for a dictionary."""

    def __init__(self, path: str):
        self.path, self.records, self.raw = path, 0, 0
        self._waiting: list[bytes] = []
        self._sink = self._compressor = None

    def _begin(self) -> None:
        made = dictionary(self._waiting)
        system, inner = _open(self.path)
        # The records are frames already; the stream must not add its own.
        self._sink = system.open_output_stream(inner, compression=None)
        content = made.as_bytes()
        self._sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content)
        self._compressor = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True)
        for raw in self._waiting:
            self._sink.write(self._compressor.compress(raw))
        self._waiting = []

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.raw += len(raw)
        if self._sink:
            self._sink.write(self._compressor.compress(raw))
            return
        self._waiting.append(raw)
        if self.raw >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> dict:
        if not self._sink:
            self._begin()
        self._sink.close()
        return {"path": self.path, "records": self.records, "raw_bytes": self.raw}


def read_archive(path: str) -> Iterator[dict]:
    """The records of an archive one by one; never more than one in memory."""
    system, inner = _open(path)
    with system.open_input_stream(inner, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError(f"{path} does not begin with a dictionary frame")
        content = source.read(size)
        kind = zstandard.DICT_TYPE_AUTO
        shared = zstandard.ZstdCompressionDict(content, dict_type=kind)
        engine = zstandard.ZstdDecompressor(dict_data=shared)
        rest, one, parts = b"", engine.decompressobj(), []
        while True:
            if not rest:
                rest = source.read(1 << 18)
                if not rest:
                    break
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
            if one.eof:
                yield parse(b"".join(parts))
                one, parts = engine.decompressobj(), []
        if any(parts):
            raise ValueError(f"{path} is cut short")


def with_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Columns id, url, payload and refers_to of every row of ``pages``.

    Of the rows whose equal payloads have at least 1000 bytes, those with the
    largest id are responses and the others refer to it. Null ids sort below
    all others; if a payload has no id at all, each row is a response. A null
    page has an empty payload. Only ids and digests are grouped; the pages
    themselves are dealt out by id.
    """
    url = col("url") if "url" in pages.columns else F.lit(None)
    full = pages.select(
        col(page_id).cast("bigint").alias("id"),
        url.cast("string").alias("url"),
        F.coalesce(col(html).cast("binary"), F.lit(b"")).alias("payload"),
    )
    # SHA-256 decides what is equal; SHA-1 is only what the archive states.
    digests = full.where(F.octet_length("payload") >= REVISIT_BYTES).select(
        "id", F.unhex(F.sha2("payload", 256)).alias("sha")
    )
    heads = digests.groupBy("sha").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = (
        digests.join(heads, "sha")
        .where("id IS NULL AND refers_to IS NOT NULL OR id < refers_to")
        .select("id", "sha", "refers_to")
        .distinct()
    )
    long = F.octet_length("payload") >= REVISIT_BYTES
    keyed = full.withColumn("sha", F.when(long, F.unhex(F.sha2("payload", 256))))
    same = keyed["id"].eqNullSafe(revisits["id"]) & (keyed["sha"] == revisits["sha"])
    return keyed.join(revisits, same, "left").select(keyed["id"], "url", "payload", "refers_to")


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    page_id: str = "page_id",
    html: str = "html",
    date: datetime | None = None,
) -> DataFrame:
    """Write a record per row of ``pages`` and return the list of archives.

    Columns of the result: path, records, raw_bytes. Each attempt of a task
    names its own files and only those of tasks that ended well are listed, so
    a lost executor leaves nothing that is read. ``folder`` must be one that all
    executors reach; by default it is below the session's work folder. An empty
    table writes no archive.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    target = folder or new_path(spark, "warc")
    system, inner = _open(target)
    system.create_dir(inner, recursive=True)
    stamp = (date or datetime(2024, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page in batch.to_pylist():
                if archive is None:
                    archive = ArchiveWriter(f"{target}/pages-{uuid.uuid4().hex}.warc.zst")
                archive.add(record(page | {"date": stamp}, page["payload"]))
                if archive.raw >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    listed = with_revisits(pages, page_id, html).mapInArrow(write, "path string, records bigint, raw_bytes bigint")
    return materialize(listed, "warc-list")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the listed archives, in tasks of whole archives."""
    spark = archives.sparkSession
    kept = ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads
    types = {"id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    arrow = pa.schema([(k, types.get(k, pa.string())) for k in kept])
    spark_types = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{f.name} {spark_types[f.type]}" for f in arrow)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for r in read_archive(path):
                    held.append({k: r[k] for k in kept})
                    size += len(r["payload"] or b"") if payloads else 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return archives.repartition(partitions(spark), "path").mapInArrow(read, schema)
