"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record file is a run of frames::

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32C of the length's bytes
    payload  a serialised sequence
    check    4 bytes: masked CRC-32C of the payload

The mask rotates the checksum right by 15 bits and adds 0xA282EAD8, so that checksums of data that holds
checksums stay useful. A payload is a 16-byte head (document id, 1 if there is one, bytes of an id, six
spare bytes) and the ids. The index file has, for each frame, its offset and its size as two 64-bit
numbers. ``manifest`` rows name the files; what no manifest names is left from attempts that failed.

Cases: a null text is an empty one, which is the end id alone; a null doc_id sorts first and comes back
null; repeated doc_ids are records of their own, in order of their texts; an empty table gives no files
and an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, storage

#: Fixed values of the format: the reflected CRC-32C polynomial and the mask's constant.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

HEAD = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("width", "u1"), ("spare", "V6")])
INDEX = np.dtype([("offset", "<i8"), ("size", "<i8")])
END_ID = 0
LANE = 256

MANIFEST = "part long, file string, index_file string, n_docs long, n_tokens long, bytes long"
SEQUENCES = "part long, doc_id long, n_tokens long, ids_crc32 long, before long"


def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(CRC32C_POLYNOMIAL), np.uint32(0))
    return crc


def _pair_table(one: np.ndarray) -> np.ndarray:
    pairs = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        pairs = (pairs >> 8) ^ one[pairs & 0xFF]
    return pairs


ONE = _byte_table()
PAIR = _pair_table(ONE)


def _lane_tables() -> np.ndarray:
    """Four tables that move a checksum over LANE zero bytes, by the byte of the checksum."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(LANE // 2):
        state = (state >> 16) ^ PAIR[state & 0xFFFF]
    return state


OVER_LANE = _lane_tables()


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of each slice of the bytes ``data``; every slice has four bytes or more.

    Slices are padded with zeros in front, which change nothing when the register begins at zero; its
    real beginning, all ones, is added to the first four bytes. All lanes of all slices advance together.
    """
    if not len(starts):
        return np.zeros(0, np.uint32)
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes)
    padded = np.zeros(int(ends[-1]) * LANE, np.uint8)
    to = ends * LANE - sizes
    for a, b, n in zip(starts.tolist(), to.tolist(), sizes.tolist(), strict=True):
        padded[b : b + n] = data[a : a + n]
    for k in range(4):
        padded[to + k] ^= 0xFF
    words = np.ascontiguousarray(padded.view("<u2").reshape(-1, LANE // 2).T)
    crc = np.zeros(int(ends[-1]), np.uint32)
    for row in words:
        crc = (crc >> 16) ^ PAIR[(crc ^ row) & 0xFFFF]
    out, first, order = np.zeros(len(starts), np.uint32), ends - lanes, np.argsort(-lanes, kind="stable")
    deep = lanes[order]
    for k in range(int(deep[0])):
        live = order[: np.searchsorted(-deep, -k, side="left")]
        was = out[live]
        moved = OVER_LANE[0][was & 0xFF] ^ OVER_LANE[1][(was >> 8) & 0xFF] ^ OVER_LANE[2][(was >> 16) & 0xFF] ^ OVER_LANE[3][was >> 24]
        out[live] = moved ^ crc[first[live] + k]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotate right by 15 bits and add the constant."""
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)


def frame(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """Frames of the sequences ``ids[bounds[i]:bounds[i + 1]]``, and their sizes."""
    n, counts = len(doc_ids), np.diff(bounds)
    payload = HEAD.itemsize + counts * width
    sizes = 16 + payload
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    lead = np.zeros(n, HEAD)
    lead["doc_id"] = [x or 0 for x in doc_ids]
    lead["has_id"] = [x is not None for x in doc_ids]
    lead["width"] = width
    length = np.ascontiguousarray(payload.astype("<i8")).view(np.uint8).reshape(n, 8)
    for k in range(8):
        out[starts + k] = length[:, k]
    for k, column in enumerate(lead.view(np.uint8).reshape(n, HEAD.itemsize).T):
        out[starts + 12 + k] = column
    body = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8)
    for s, a, b in zip((starts + 12 + HEAD.itemsize).tolist(), (bounds[:-1] * width).tolist(), (bounds[1:] * width).tolist(), strict=True):
        out[s : s + b - a] = body[a:b]
    checks = ((8, masked(crc32c(length.reshape(-1), np.arange(n) * 8, np.full(n, 8)))), (12 + payload, masked(crc32c(out, starts + 12, payload))))
    for at, check in checks:
        for k in range(4):
            out[starts + at + k] = (check >> np.uint32(8 * k)) & 0xFF
    return out.tobytes(), sizes


def unframe(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and token ids of the frames in ``data``; raises ValueError on a wrong checksum."""
    raw, starts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(data):
        starts.append(at)
        at += 16 + int.from_bytes(data[at : at + 8], "little")
    if at != len(data):
        raise ValueError("a frame is cut off")
    begin = np.array(starts, np.int64)
    if not len(begin):
        return [], []
    payload = np.diff(np.append(begin, at)) - 16
    stored = [np.array([int.from_bytes(data[x : x + 4], "little") for x in where], np.uint32) for where in (begin + 8, begin + 12 + payload)]
    if (masked(crc32c(raw, begin, np.full(len(begin), 8))) != stored[0]).any() or (masked(crc32c(raw, begin + 12, payload)) != stored[1]).any():
        raise ValueError("a checksum differs")
    doc_ids, ids = [], []
    for s, p in zip(starts, payload.tolist(), strict=True):
        lead = np.frombuffer(data, HEAD, 1, s + 12)[0]
        doc_ids.append(int(lead["doc_id"]) if lead["has_id"] else None)
        ids.append(np.frombuffer(data, f"<u{lead['width']}", (p - HEAD.itemsize) // int(lead["width"]), s + 12 + HEAD.itemsize))
    return doc_ids, ids


#: Bytes of text that a writing task encodes at once.
WRITE_BYTES = 8 << 20


def write_sequences(docs: DataFrame, folder: str, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text and write record files in ascending order of id; returns the manifest.

    Rows are dealt by ranges of the id, so a file holds a run of ids and files are ordered among
    themselves. A task holds one step of texts at a time.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = bpe.json_encoder(tokenizer_path)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 65536 else 4
        part = TaskContext.get().partitionId()
        out = index = None
        n_docs = n_tokens = at = 0
        for batch in batches:
            for begin, end in bpe.text_steps(batch.column(1), WRITE_BYTES):
                step = batch.slice(begin, end - begin)
                if out is None:
                    fs, root = storage.open_fs(folder)
                    fs.create_dir(root, recursive=True)
                    name = storage.unique_name(f"part-{part:06d}")
                    out, index = fs.open_output_stream(f"{root}/{name}.records"), fs.open_output_stream(f"{root}/{name}.index")
                ids, bounds = encoder.encode(step.column(1))
                ids = np.insert(ids, bounds[1:], END_ID)
                bounds = bounds + np.arange(len(bounds))
                data, sizes = frame(step.column(0).to_pylist(), ids, bounds, width)
                out.write(data)
                entries = np.zeros(len(sizes), INDEX)
                entries["offset"], entries["size"] = at + np.cumsum(sizes) - sizes, sizes
                index.write(entries.tobytes())
                at += len(data)
                n_docs += len(sizes)
                n_tokens += len(ids)
        if out is not None:
            out.close()
            index.close()
            row = {"part": part, "file": f"{folder}/{name}.records", "index_file": f"{folder}/{name}.index", "n_docs": n_docs, "n_tokens": n_tokens, "bytes": at}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("file", pa.string()), ("index_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())]))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return storage.written(ordered.mapInArrow(write, MANIFEST), f"{folder}/manifest")


#: Bytes of a record file that a reading task holds at once.
READ_BYTES = 8 << 20


def read_sequences(manifest: DataFrame) -> DataFrame:
    """One row per record from the files: part, doc_id, n_tokens, ids_crc32, and all ids before it.

    The manifest has a row for each file; the ids of earlier files are summed there, before any record is read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = storage.open_fs(row["file"])
                index_fs, index_path = storage.open_fs(row["index_file"])
                with index_fs.open_input_stream(index_path) as f:
                    entries = np.frombuffer(f.read(), INDEX)
                before = row["earlier"]
                with fs.open_input_stream(path) as f:
                    begin = 0
                    while begin < len(entries):
                        limit = entries["offset"][begin] + max(READ_BYTES, entries["size"][begin])
                        end = begin + int(np.searchsorted((entries["offset"] + entries["size"])[begin:], limit, side="right"))
                        doc_ids, ids = unframe(f.read(int(entries["size"][begin:end].sum())))
                        counts = np.array([len(x) for x in ids], np.int64)
                        starts = before + np.cumsum(counts) - counts
                        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                        yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(ids), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64()), "before": pa.array(starts)})
                        before += int(counts.sum())
                        begin = end

    tasks = max(1, min(manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism * 4))
    earlier = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("earlier", earlier).repartition(tasks).mapInArrow(read, SEQUENCES)


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """Records in an order set by ``seed``, each fetched by its offset: order long, doc_id long, ids array<long>."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened: dict = {}
            for row in batch.to_pylist():
                if row["file"] not in opened:
                    fs, path = storage.open_fs(row["file"])
                    opened = {row["file"]: fs.open_input_file(path)}
                (doc_id,), (ids,) = unframe(opened[row["file"]].read_at(row["size"], row["offset"]))
                yield pa.RecordBatch.from_pydict({"order": pa.array([row["order"]], pa.int64()), "doc_id": pa.array([doc_id], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = storage.open_fs(row["index_file"])
                with fs.open_input_stream(path) as f:
                    found = np.frombuffer(f.read(), INDEX)
                yield pa.RecordBatch.from_pydict({"file": pa.array([row["file"]] * len(found)), "offset": pa.array(found["offset"]), "size": pa.array(found["size"])})

    listed = manifest.mapInArrow(entries, "file string, offset long, size long")
    ordered = listed.withColumn("order", F.xxhash64("file", "offset", F.lit(seed))).repartitionByRange("order").sortWithinPartitions("order")
    return ordered.mapInArrow(fetch, "order long, doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents, read the files back, and give doc_id, start, n_tokens and ids_crc32 of each."""
    manifest = write_sequences(docs, storage.work_dir(docs.sparkSession, "records"), tokenizer_path)
    return read_sequences(manifest).select("doc_id", F.col("before").alias("start"), "n_tokens", "ids_crc32")
