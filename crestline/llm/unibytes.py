"""Byte-level BPE by the ``tokenizers`` library over Arrow batches, with offsets, and its decoding.

A rank file becomes a vocabulary of characters that stand for bytes, so the library's merges give the ids
that merging bytes by rank gives. Decoding goes back through the same table: tokens become bytes and the
bytes of a document are joined before they are read as UTF-8, so a character split over tokens is whole
again. ``encode_documents`` keeps ids and, for each token, the byte offset at which it begins.

Cases: a null text is an empty one, without tokens; a null doc_id is carried; repeated rows give a row
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


class ByteTable:
    """The bytes of each token, end to end."""

    def __init__(self, tokenizer):
        back = {c: b for b, c in bpe.byte_alphabet().items()}
        vocabulary = sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        table = [b""] * (vocabulary[-1][1] + 1)
        for token, i in vocabulary:
            table[i] = bytes(back[c] for c in token)
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a run of ids, and where each token ends."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return np.zeros(0, np.uint8), ends
        return self.pool[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)], ends


_tables: dict[int, ByteTable] = {}


def byte_table(encoder: bpe.CachedEncoder) -> ByteTable:
    """The table of an encoder, one for each Python worker."""
    if id(encoder) not in _tables:
        _tables[id(encoder)] = ByteTable(encoder.tokenizer)
    return _tables[id(encoder)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<int>: of each token, the byte of the text where it begins."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.ranks_encoder(ranks_path, pattern)
        table = byte_table(encoder)
        for batch in batches:
            for begin, end in bpe.text_steps(batch.column(1)):
                step = batch.slice(begin, end - begin)
                ids, bounds = encoder.encode(step.column(1))
                ends = np.cumsum(table.sizes[ids])
                begins = np.concatenate([[0], ends])[: len(ids)]
                each = np.repeat(np.concatenate([[0], ends])[bounds[:-1]], np.diff(bounds))
                to = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([step.column(0), to(ids), to(begins - each)], names=["doc_id", "ids", "offsets"])

    return _rows(docs).mapInArrow(encode, "doc_id long, ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text: the bytes of ``ids`` read as UTF-8; bytes that are none become U+FFFD."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(bpe.ranks_encoder(ranks_path, pattern))
        for batch in batches:
            texts = [table.decode(np.array(x or [], np.int64))[0].tobytes().decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids, and give digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids and bytes stay in the worker that made them; only digests leave it.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.ranks_encoder(ranks_path, pattern)
        table = byte_table(encoder)
        names = np.array([f"{i}," for i in range(len(table.sizes))], dtype="S")
        widths = np.char.str_len(names).astype(np.int64)
        spelled = np.frombuffer(b"".join(names.tolist()), np.uint8)
        first = np.cumsum(widths) - widths
        for batch in batches:
            for begin, end in bpe.text_steps(batch.column(1), 2 << 20):
                step = batch.slice(begin, end - begin)
                ids, bounds = encoder.encode(step.column(1))
                ends = np.concatenate([[0], np.cumsum(widths[ids])])
                decimal = spelled[np.arange(ends[-1]) + np.repeat(first[ids] - ends[:-1], widths[ids])].tobytes()
                decoded, stops = table.decode(ids)
                stops = np.concatenate([[0], stops])
                decoded = decoded.tobytes()
                pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                sha = lambda data: hashlib.sha256(data).hexdigest()
                ids_sha = [sha(decimal[ends[a] : max(ends[a], ends[b] - 1)]) for a, b in pairs]
                text_sha = [sha(decoded[stops[a] : stops[b]]) for a, b in pairs]
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
