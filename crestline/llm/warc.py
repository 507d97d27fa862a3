"""WARC archives: writing pages as records, and a normaliser for archives that are one gzip stream.

``write_monolithic`` writes one archive for each task, compressed as a whole, as some crawlers do. Such a
file can only be read from its start. ``normalise`` inflates each file once, as a stream, rewrites every
record as a gzip member of its own and writes a sidecar index with each member's offset and length, so
that a reader can fetch any record alone. ``read_records`` reads through the index.

Of pages with equal payloads, the one with the smallest page_id is written as a response and the others
as revisits that refer to it. Only ids and digests meet by digest; the payloads travel by page_id and digest
together, so a payload that many pages share is spread over tasks.

Cases: a null html is an empty payload; equal empty payloads are revisits like others when
``min_revisit_bytes`` is 0; rows that repeat the smallest page_id of a payload are responses all; a null
page_id is carried as null, and is a revisit where its payload also has a page_id; a null url becomes
``urn:none`` and other urls are percent-encoded where a header needs it; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 20
MANIFEST = "file string, index_file string, n_records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_head(kind: str, page_id: int | None, url: str | None, digest: str, payload_bytes: int, refers_to: int | None, block_bytes: int) -> bytes:
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:none"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block_bytes}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with an equal payload, where that is another."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.when(F.octet_length("html") >= min_revisit_bytes, F.sha1("html")))
    digests = keyed.filter("digest IS NOT NULL").select("page_id", "digest")
    repeated = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first_id")
    later = digests.join(repeated, "digest").filter(~F.col("first_id").eqNullSafe(F.col("page_id"))).distinct()
    later = later.select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), F.col("first_id").alias("refers_to"))
    joined = keyed.join(later, keyed["page_id"].eqNullSafe(later["later_id"]) & (keyed["digest"] == later["later_digest"]), "left")
    return joined.select("page_id", "url", "html", "refers_to")


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write page_id, url, html, refers_to as archives, each one gzip stream; returns file, n_records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs, root = storage.open_fs(folder)
                    fs.create_dir(root, recursive=True)
                    name = storage.unique_name("mono") + ".warc.gz"
                    out, packer = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = row["html"].encode()
                digest, revisit = digest_of(payload), row["refers_to"] is not None
                block = b"" if revisit else http_head(len(payload)) + payload
                head = record_head("revisit" if revisit else "response", row["page_id"], row["url"], digest, len(payload), row["refers_to"], len(block))
                size += out.write(packer.compress(head + block + b"\r\n\r\n"))
                n += 1
        if out is not None:
            size += out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return storage.written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "file string, n_records long, bytes long"), f"{folder}/manifest")


def _heads(stream: io.BufferedIOBase) -> Iterator[tuple[bytes, int]]:
    """Each record's head and block length; the caller reads the block before it goes on."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head, length = [line], None
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record's head is cut off")
            head.append(line)
            if line[:15].lower() == b"content-length:":
                length = int(line[15:])
        if length is None:
            raise ValueError("a record has no Content-Length")
        yield b"".join([*head, b"\r\n"]), length


def normalise_file(source: io.RawIOBase, out, index, level: int = 3) -> tuple[int, int]:
    """Inflate ``source`` once and write each record as a member; returns records and bytes written.

    Blocks pass through in chunks, so a record's size does not bound memory.
    """
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source), CHUNK)
    n = at = 0
    for head, length in _heads(stream):
        packer, begin = zlib.compressobj(level, zlib.DEFLATED, 31), at
        at += out.write(packer.compress(head))
        left = length
        while left:
            data = stream.read(min(CHUNK, left))
            if not data:
                raise ValueError("a record's block is cut off")
            left -= len(data)
            if packed := packer.compress(data):
                at += out.write(packed)
        at += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        index.write(f"{begin}\t{at - begin}\n".encode())
        n += 1
    return n, at


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise the archives named in column ``file``, one task a file; returns the manifest."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = storage.open_fs(file)
                to, root = storage.open_fs(folder)
                to.create_dir(root, recursive=True)
                name = storage.unique_name("records") + ".warc.gz"
                with fs.open_input_file(path) as source, to.open_output_stream(f"{root}/{name}", compression=None) as out, to.open_output_stream(f"{root}/{name}.index", compression=None) as index:
                    n, size = normalise_file(source, out, index)
                yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "index_file": [f"{folder}/{name}.index"], "n_records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return storage.written(_one_each(archives).select("file").mapInArrow(rewrite, MANIFEST), f"{folder}/manifest")


def _one_each(files: DataFrame) -> DataFrame:
    """Deal files out to tasks."""
    return files.repartition(max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism)))


def parse_record(data: bytes) -> dict:
    """A record's fields; raises ValueError where payload and digest differ."""
    ((head, length),) = list(_heads_of(data))
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)}
    block = data[len(head) : len(head) + length]
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    number = lambda x: None if x[10:-1] == "none" else int(x[10:-1])
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and digest_of(payload) != digest:
        raise ValueError("a payload differs from its digest")
    return {"page_id": number(fields["warc-record-id"]), "payload_bytes": len(payload) if payload is not None else int(fields["x-payload-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None, "url": fields["warc-target-uri"], "payload": payload}


def _heads_of(data: bytes) -> Iterator[tuple[bytes, int]]:
    stream = io.BytesIO(data)
    for head, length in _heads(stream):
        yield head, length
        stream.seek(length, 1)


def read_records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Read every record through the index: each member is fetched by its offset and inflated alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                index_fs, index_path = storage.open_fs(row["index_file"])
                with index_fs.open_input_stream(index_path) as f:
                    entries = [tuple(map(int, line.split())) for line in f.read().decode().splitlines()]
                fs, path = storage.open_fs(row["file"])
                with fs.open_input_file(path) as f:
                    rows: list[dict] = []
                    held = 0
                    for offset, size in entries:
                        record = parse_record(zlib.decompress(f.read_at(size, offset), 31))
                        if not payloads:
                            record["payload"] = None
                        rows.append(record)
                        held += len(record["payload"] or b"") + 200
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _one_each(manifest).mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages, normalise the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    mono, folder = storage.work_dir(spark, "warc-mono"), storage.work_dir(spark, "warc")
    archives = write_monolithic(with_revisits(pages, min_revisit_bytes), mono)
    manifest = normalise(archives, folder)
    storage.drop_dir(spark, mono)
    return read_records(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for ``archive_pages``.
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
