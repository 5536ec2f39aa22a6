"""WARC archives written from a table, and read back as a chunked record table (operator 1).

``write_archives`` turns rows into WARC/1.1 records, one gzip member each, in one file per task.
``read_chunks`` streams the archives: a payload becomes rows (record_id, chunk_no, data) of at most
``chunk_bytes`` with the SHA-256 and the byte count of everything up to and including the chunk, so
no record is ever held whole, however large it is.

Archives of others are read too: any WARC version and record type, gzipped or plain. What is
``application/http`` has its HTTP head taken off, everything else is payload; a digest that is not
SHA-256 is left alone, and ``row_id`` and ``refers_to`` are null. For a revisit, which has no payload of
its own, size and digest are what it declares. Records written here are verified when they are read.

Only digests are shuffled to find equal payloads; the few that occur again are broadcast behind a count
(of fixed-width rows), beyond that the join with them is salted.

Recovery: a task writes to a name of its own attempt and renames it when it is complete, so a lost
or repeated task leaves exactly one whole file.

Nulls and odd cases: a null payload is an empty one; a null url is written as ``urn:x-missing:url``;
a null id is kept as null and, among equal payloads, comes after all others; rows that repeat the
smallest id of a group of equal payloads are all responses (each is that record); a long payload is
never held whole when it is read; a line of a head beyond ``MAX_LINE`` bytes is an error; an empty table
gives an empty chunk table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import string
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, salt, spread, table

CHUNK_SCHEMA = (
    "archive string, record_offset long, record_id string, row_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, chunk_no long, data binary, bytes_so_far long, digest_so_far string, is_last boolean"
)
ARROW_CHUNKS = pa.schema(
    [
        (name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[kind])
        for name, kind in (column.split() for column in CHUNK_SCHEMA.split(", "))
    ]
)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16
BROADCAST_DIGESTS = 500_000  # of a digest and an id
MAX_LINE = 1 << 20
PIECE = 1 << 20
FLUSH_BYTES = 4 << 20


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def resolve_revisits(rows: DataFrame, min_revisit_bytes: int = 100, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Rows ``(row_id, url, payload binary)`` with digest, size and ``refers_to``: of equal payloads of at
    least ``min_revisit_bytes`` all but the smallest id refer to it. Only digests are grouped (with
    partial aggregation); a hot digest is salted where it is not broadcast."""
    sized = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    originals = (
        sized.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.min("row_id").alias("original"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    originals = cut(originals, "originals")
    if originals.count() <= broadcast_digests:
        joined = sized.join(F.broadcast(originals), "payload_digest", "left")
    else:
        joined = salt(sized, F.coalesce("row_id", F.lit(-1)), SALTS).join(spread(originals, SALTS), ["payload_digest", "_salt"], "left").drop("_salt")
    other = F.col("row_id").isNull() | (F.col("row_id") != F.col("original"))
    return joined.withColumn("refers_to", F.when(F.col("original").isNotNull() & other, F.col("original"))).drop("original")


def _record_id(row_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row_id}:{digest}')}>"


def _head(row: dict, date: str) -> bytes:
    revisit = row["refers_to"] is not None
    uri = quote(row["url"], safe=string.ascii_letters + string.digits + string.punctuation) if row["url"] else "urn:x-missing:url"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(row['row_id'], row['payload_digest'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(HTTP_HEAD) + (0 if revisit else row['payload_bytes'])}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["row_id"] is not None:
        fields.append(f"X-Row-Id: {row['row_id']}")
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(row['refers_to'], row['payload_digest'])}", f"X-Refers-To-Row: {row['refers_to']}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + HTTP_HEAD


def write_archives(rows: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 100) -> DataFrame:
    """Writes ``rows(row_id, url, payload binary)`` to ``folder``; returns (archive, records) of the files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        attempt = f"{root}/_attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        records, sink = 0, None
        for batch in batches:
            columns = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in columns if c != "payload"}
                if sink is None:
                    sink = system.open_output_stream(attempt, compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                sink.write(pack.compress(_head(row, date)))
                if row["refers_to"] is None:
                    payload = memoryview(batch.column("payload")[i].as_buffer())
                    for at in range(0, len(payload), PIECE):
                        sink.write(pack.compress(payload[at : at + PIECE]))
                sink.write(pack.compress(b"\r\n\r\n") + pack.flush())
                records += 1
        if sink is not None:
            sink.close()
            system.move(attempt, name)
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return resolve_revisits(rows, min_revisit_bytes).mapInArrow(write, "archive string, records long")


class _Inflated:
    """The bytes of a file of gzip members, or of a plain one, read in bounded pieces."""

    def __init__(self, raw):
        self.raw, self.unpack, self.buffer, self.ended, self.at = raw, zlib.decompressobj(31), b"", False, 0
        self.first = raw.read(2)
        self.plain = self.first != b"\x1f\x8b"

    def _more(self) -> bool:
        if self.plain:
            data, self.first = self.first + self.raw.read(1 << 16), b""
            self.buffer += data
            return bool(data)
        while not self.ended:
            data = self.unpack.unconsumed_tail or self.unpack.unused_data or self.first + self.raw.read(1 << 16)
            self.first = b""
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            if not data:
                self.ended = True
                return False
            if piece := self.unpack.decompress(data, PIECE):
                self.buffer += piece
                return True
        return False

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\n")) < 0:
            if len(self.buffer) > MAX_LINE:
                raise ValueError(f"a line of more than {MAX_LINE} bytes at {self.at}")
            if not self._more():
                end = len(self.buffer) - 1
                break
        found, self.buffer = self.buffer[: end + 1], self.buffer[end + 1 :]
        self.at += len(found)
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        found, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(found)
        return found


def _hex_sha256(declared: str | None) -> str | None:
    """The bare lower-case hex of ``sha256:...``, given in hex or base32; what is of another algorithm stays as it is."""
    name, _, value = (declared or "").partition(":")
    if name.lower().replace("-", "") == "sha256" and len(value) == 64:
        return value.lower()
    if name.lower().replace("-", "") == "sha256" and len(value.rstrip("=")) == 52:
        return base64.b32decode(value.rstrip("=").upper() + "====").hex()
    return declared


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _chunks(archive: str, stream: _Inflated, chunk_bytes: int) -> Iterator[tuple]:
    while True:
        offset, line = stream.at, stream.line()
        while line in (b"\r\n", b"\n"):
            offset, line = stream.at, stream.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no WARC record at {offset}")
        head: dict[str, str] = {}
        while (line := stream.line()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.lower()] = value.strip()
        left, digest, size, number = int(head.get("content-length", 0)), hashlib.sha256(), 0, 0
        kind, own = head.get("warc-type"), "x-payload-length" in head
        if head.get("content-type", "").lower().startswith("application/http"):
            while left > 0 and (line := stream.line()):
                left -= len(line)
                if not line.strip():
                    break
        total, declared = left, _hex_sha256(head.get("warc-payload-digest"))
        if kind == "revisit":
            total = _number(head.get("x-payload-length"))
        row, refers = _number(head.get("x-row-id")), _number(head.get("x-refers-to-row"))
        same = (archive, offset, head.get("warc-record-id"), row, head.get("warc-target-uri"), kind, refers, total)
        while True:
            data = stream.take(min(left, chunk_bytes))
            left, size = left - len(data), size + len(data)
            digest.update(data)
            if left and not data:
                raise ValueError(f"{archive}: the record at {offset} is cut off")
            if own and not left and kind == "response" and (digest.hexdigest() != declared or size != int(head["x-payload-length"])):
                raise ValueError(f"{archive}: the record at {offset} does not have its digest")
            # a record's digest is known at its end; a record written here declares it
            of_record = declared if own or kind == "revisit" else digest.hexdigest() if not left else None
            yield (*same, of_record, number, data, size, digest.hexdigest(), not left)
            number += 1
            if not left:
                break


def read_chunks(spark: SparkSession, folder: str, *, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunked record table of all ``*.warc.gz`` and ``*.warc`` in ``folder``.

    ``payload_digest`` is in a record's last chunk, and in all if the record declares it as SHA-256."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for archive in batch.column("path").to_pylist():
                system, path = _filesystem(archive)
                with system.open_input_stream(path, compression=None) as raw:
                    for row in _chunks(archive, _Inflated(raw), chunk_bytes):
                        rows.append(row)
                        held += len(row[10]) + 200
                        if held >= FLUSH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW_CHUNKS)], schema=ARROW_CHUNKS)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW_CHUNKS)], schema=ARROW_CHUNKS)

    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path")
    return files.mapInArrow(read, CHUNK_SCHEMA)


def op1_warc_chunked(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").cast("long").alias("row_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    folder = fresh_path(spark, "warc")
    write_archives(rows, folder).agg(F.sum("records")).collect()
    return read_chunks(spark, folder).where("is_last").select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS original FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, s.payload_digest, CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original IS NOT NULL AND original <> page_id THEN original END AS refers_to
FROM sized s LEFT JOIN firsts f ON s.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
