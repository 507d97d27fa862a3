"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids are its text's ids and an end id. Each full sequence of a document stands alone; what is
left over, shorter than a sequence, is cut by halves into pieces down to ``PIECE`` ids and packed with others
of the same task: ``BUNDLE`` ids of them make a bundle. Differencing starts from one partial partition for
each piece and keeps merging the two with the largest spread, the fullest windows of the one onto the
emptiest of the other, until one partition is left, whose windows are nearly equal and are the result. A
bundle begins with the fewest windows that could hold it; whenever one of them is over capacity, the count
rises and the differencing is done again, so each window of a bundle has a few ids of padding.

Every task packs the rows of its own partition, so nothing is shuffled, and a bundle bounds its memory.
The rows of a partition come in one order whenever it is read again from files, so a task that is run
again packs alike.

Cases: a null text is an empty one, which is the end id alone; a null doc_id is carried; repeated rows
are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from operator import add, neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, storage

END_ID = 0
CAPACITY = 1024
PIECE = 16
BUNDLE = 384 * 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Numbers of the items in each of ``k`` windows, by largest differencing over ``k`` ways."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    # a partial partition: loads from high to low without the windows it leaves empty, and their items
    heap = [(-sizes[i], n, [sizes[i]], [[i]]) for n, i in enumerate(order)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, loads, items = heapq.heappop(heap)
        _, _, loads_b, items_b = heapq.heappop(heap)
        over = len(loads) + len(loads_b) - k
        if len(loads_b) == 1 and len(loads) == k:  # one item goes into the emptiest window
            load, own = loads.pop() + loads_b[0], items.pop() + items_b[0]
            at = bisect_right(loads, -load, key=neg)
            loads.insert(at, load)
            items.insert(at, own)
        elif over > 0:  # the fullest windows of the one take the emptiest of the other
            at = len(loads) - over
            loads[at:] = map(add, loads[at:], reversed(loads_b))
            for own, more in zip(items[at:], reversed(items_b), strict=False):
                own += more
            loads += loads_b[-over - 1 :: -1] if over < len(loads_b) else []
            items += items_b[-over - 1 :: -1] if over < len(items_b) else []
        else:  # each filled window of the one meets an empty one of the other
            loads += loads_b
            items += items_b
        if len(loads_b) > 1 and (over > 0 or loads[-len(loads_b) - 1] < loads_b[0]) or over <= 0 and loads[-len(loads_b) - 1] < loads_b[0]:
            rank = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
            loads, items = [loads[i] for i in rank], [items[i] for i in rank]
        heapq.heappush(heap, (-(loads[0] - (loads[-1] if len(loads) == k else 0)), n, loads, items))
        n += 1
    return [own for own in heap[0][3] if own] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the items in each window, none over ``capacity``; no item may be.

    Differencing begins with the fewest windows that could hold the items. Whenever a window is over
    capacity the count rises and the differencing is done again.
    """
    k = -(-sum(sizes) // capacity)
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[i] for i in own) <= capacity for own in windows):
            return windows
        k += 1


def halves(begin: int, end: int, least: int) -> list[tuple[int, int]]:
    """Runs that each take half of the ids still left, or ``least`` of them: sizes of every order to balance with."""
    out = []
    while begin < end:
        to = min(end, begin + max(least, -(-(end - begin) // 2)))
        out.append((begin, to))
        begin = to
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE, bundle: int = BUNDLE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = bpe.json_encoder(tokenizer_path)
        next_id = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []  # doc_id, start, bytes of the ids, doc_tokens
        held = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        def flush() -> list[tuple]:
            nonlocal next_id, waiting, held
            rows = []
            for own in pack([len(x[2]) // 4 for x in waiting], capacity):
                offset = 0
                for i in own:
                    doc_id, start, data, doc_tokens = waiting[i]
                    n = len(data) // 4
                    rows.append((doc_id, start, n, zlib.crc32(data), doc_tokens, next_id, offset))
                    offset += n
                next_id += 1
            waiting, held = [], 0
            return rows

        for batch in batches:
            for begin, end in bpe.text_steps(batch.column(1)):
                step = batch.slice(begin, end - begin)
                ids, bounds = encoder.encode(step.column(1))
                raw = np.insert(ids, bounds[1:], END_ID).astype("<u4").tobytes()
                bounds = (bounds + np.arange(len(bounds))).tolist()
                rows: list[tuple] = []
                for doc_id, a, b in zip(step.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    n = b - a
                    full = n - n % capacity
                    for x in range(0, full, capacity):
                        rows.append((doc_id, x, capacity, zlib.crc32(raw[4 * (a + x) : 4 * (a + x + capacity)]), n, next_id, 0))
                        next_id += 1
                    if n > full:
                        for x, y in halves(full, n, piece):
                            waiting.append((doc_id, x, raw[4 * (a + x) : 4 * (a + y)], n))
                        held += n - full
                        if held >= bundle:
                            rows += flush()
                if rows:
                    yield out(rows)
        if waiting:
            yield out(flush())
        storage.give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(packed, PIECES)
