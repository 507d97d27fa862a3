"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of ``BOOKS`` full-dimensional codebooks. They
start as residual codebooks (k-means of what the earlier ones leave) and are then fitted together by least
squares to the codes that a beam search finds. Every row is encoded by the same beam search and stored
with its codes, the squared norm of its approximation, how far that lies from the vector, and the vector
itself. A query's table of products with all codewords gives a score for each stored row by lookups; the best
of them, one in ``RERANK_PART`` of each block of the index, are then measured exactly, in double precision. A
row's approximation cannot be nearer to it than it is stored to be, so the score also gives the least distance
that the row can have: rows whose least distance is within the block's ``top``-th measured one are measured as
well, all others are ruled out. The nearest of all blocks are kept.

Rows lie in lists by the codeword of the first codebook that is nearest to them, and a query visits the lists
nearest to it. How many is measured on the sample: the fewest that hold ``PROBED`` of the true neighbours
there. Vectors in clusters need few; vectors that spread evenly in all directions need most of the lists.
Then it visits each further list that may hold a row nearer than the last one found: a list lies behind the
planes between its codeword and every other, and a query is no nearer to its rows than to the farthest of these.
So nothing is missed, whatever the sample holds; what a bound cannot rule out costs time only.
A list of more than ``BLOCK_ROWS`` rows is dealt out to several blocks. A task holds one block, and the
queries that visit it pass by, so what it holds grows neither with the rows nor with the queries.

The codebooks are fitted on at most ``SAMPLE`` rows, those with the smallest hash of vec_id.

Cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows without a vec_id; ties go to the smaller vec_id; a repeated vec_id is
one query, whose own rows are no candidates, and is a candidate for each of its rows; fewer candidates
than asked for give all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

BOOKS, WORDS, BEAM = 16, 64, 8
SAMPLE = 8192
ROUNDS = 3
#: One in so many rows of a block is measured exactly.
RERANK_PART = 8
#: The share of true neighbours that the visited lists hold, and the sample's queries that it is measured by.
PROBED, PROBE_QUERIES = 0.99, 512
BLOCK_ROWS, QUERY_ROWS = 16384, 1024
SEED = 7

FOUND = "query_id long, vec_id long, score double"


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books): at each codebook the ``beam`` best partial sums are carried on."""
    m, k, _ = books.shape
    norms = (books**2).sum(-1)
    out = np.zeros((len(x), m), np.uint8)
    for begin in range(0, len(x), 512):
        part = x[begin : begin + 512]
        n = len(part)
        left, codes = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
        error = (part**2).sum(-1)[:, None]
        for j in range(m):
            cost = (error[:, :, None] - 2 * left @ books[j].T + norms[j]).reshape(n, -1)
            keep = min(beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.tile(np.arange(keep), (n, 1))
            at, word = best // k, best % k
            row = np.arange(n)[:, None]
            codes = np.concatenate([codes[row, at], word[:, :, None].astype(np.uint8)], axis=2)
            left = left[row, at] - books[j][word]
            error = cost[row, best]
        out[begin : begin + 512] = codes[np.arange(n), error.argmin(1)]
    return out


def approximate(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def fit_codebooks(x: np.ndarray, m: int = BOOKS, k: int = WORDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Codebooks (m, k, dimension): residual k-means, then least squares on the codes of beam search."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    k = min(k, len(x))
    books, left = np.zeros((m, k, x.shape[1])), x.copy()
    for j in range(m):
        words = left[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(8):
            own = ((words**2).sum(-1) - 2 * left @ words.T).argmin(1)
            size = np.bincount(own, minlength=k)
            for d in range(x.shape[1]):
                words[:, d] = np.where(size > 0, np.bincount(own, weights=left[:, d], minlength=k) / np.maximum(size, 1), words[:, d])
        books[j] = words
        left -= words[((words**2).sum(-1) - 2 * left @ words.T).argmin(1)]
    for _ in range(rounds):
        codes = beam_encode(x, books).astype(np.int64)
        at = codes + np.arange(m) * k
        gram = np.zeros((m * k, m * k))
        for i in range(m):
            for j in range(m):
                np.add.at(gram, (at[:, i], at[:, j]), 1.0)
        right = np.zeros((m * k, x.shape[1]))
        for i in range(m):
            np.add.at(right, at[:, i], x)
        ridge = 1e-3
        books = np.linalg.solve(gram + ridge * np.eye(m * k), right + ridge * books.reshape(m * k, -1)).reshape(m, k, -1)
    return books


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part; components stay floats or become doubles."""
    element = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def lists_by_distance(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The lists of each row, nearest first."""
    return np.argsort((words**2).sum(-1) - 2 * x @ words.T, axis=1, kind="stable")


def list_bounds(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(rows, lists): the least distance that a vector of each list can have from each row."""
    apart = np.sqrt(np.maximum((words**2).sum(-1)[:, None] - 2 * words @ words.T + (words**2).sum(-1), 0))
    far = apart > 1e-6 * max(apart.max(initial=0), 1e-300)
    out = np.zeros((len(x), len(words)))
    for i, row in enumerate(x):
        square = ((words - row) ** 2).sum(-1)
        # what rounding can add is taken off
        less = 1e-9 * (square.max(initial=0) + (row**2).sum())
        plane = np.where(far, (square[:, None] - square[None, :] - less) / np.where(far, 2 * apart, 1.0), 0.0)
        out[i] = plane.max(axis=1, initial=0)
    return out


def lists_to_visit(sample: np.ndarray, words: np.ndarray, top: int) -> int:
    """The fewest lists that hold PROBED of the sample's true neighbours of some of its rows."""
    if len(sample) <= top + 1:
        return len(words)
    order = lists_by_distance(sample, words)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    visited = []
    norms = (sample**2).sum(-1)
    for i in range(min(PROBE_QUERIES, len(sample))):
        distance = norms - 2 * sample @ sample[i]
        distance[i] = np.inf
        visited.append(place[i, order[np.argpartition(distance, top)[:top], 0]])
    return int(np.quantile(np.concatenate(visited), PROBED, method="higher")) + 1


def build_index(rows: DataFrame, books: np.ndarray, folder: str) -> DataFrame:
    """Encode every row and write the index: vec_id, embedding, list, codes, norm and error of the approximation."""
    schema = f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, list int, codes binary, norm double, error double"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            codes = beam_encode(x, books)
            near = approximate(codes, books)
            norm, error = (near**2).sum(-1), np.sqrt(((x - near) ** 2).sum(-1))
            nearest_list = lists_by_distance(x, books[0])[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest_list), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(error)], names=["vec_id", "embedding", "list", "codes", "norm", "error"])

    return storage.written(rows.mapInArrow(encode, schema), f"{folder}/index")


class IndexBlock:
    """Rows of one list, held while queries pass by."""

    def __init__(self, parts: list[pa.RecordBatch], books: np.ndarray):
        of = lambda name: [p.column(name) for p in parts]
        self.books = books
        self.ids = np.concatenate([c.to_numpy() for c in of("vec_id")])
        self.x = np.concatenate([_matrix(c) for c in of("embedding")])
        self.codes = np.frombuffer(b"".join(x for c in of("codes") for x in c.to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.norm, self.error = (np.concatenate([c.to_numpy() for c in of(name)]) for name in ("norm", "error"))
        self.square = (self.x**2).sum(-1)
        self.scale = self.norm + (np.abs(books).max(initial=0) ** 2) * books.shape[0] * books.shape[2]

    def measured(self, near: np.ndarray, query: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` nearest of the rows ``near``, ties to the smaller id, and their distances in double precision."""
        square, own = self.square[near], float(query @ query)
        rough, slack = square - 2 * (self.x[near] @ query) + own, 1e-12 * (square + own)
        if len(near) > top:  # those that rounding may put among the nearest
            most = np.partition(rough + slack, top - 1)[top - 1]
            near = near[~(rough - slack > most)]
        exact = np.sqrt(((self.x[near] - query) ** 2).sum(-1))
        best = np.lexsort((self.ids[near], exact))[:top]
        return near[best], exact[best]

    def search(self, q_ids: np.ndarray, q: np.ndarray, top: int, part: int) -> pa.RecordBatch:
        """The nearest rows of the block to each query: by lookups, then exactly among all that these do not rule out."""
        tables = np.einsum("qd,mkd->qmk", q, self.books)
        depth = max(top, -(-len(self.ids) // part))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(q)):
            score = self.norm - 2 * sum(tables[i, j][self.codes[:, j]] for j in range(len(self.books)))
            other = self.ids != q_ids[i]
            score[~other] = np.inf
            near = np.argpartition(score, depth - 1)[:depth] if depth < len(self.ids) else np.arange(len(self.ids))
            best, exact = self.measured(near[other[near]], q[i], top)
            if depth < len(self.ids):
                own = float(q[i] @ q[i])
                least = np.sqrt(np.maximum(score + own - 1e-11 * (self.scale + own), 0)) - self.error * (1 + 1e-9)
                # without enough rows so far nothing is ruled out
                open_ = other & ~(least > (exact[-1] if len(best) == top else np.inf))
                open_[near] = False
                if open_.any():
                    best, exact = self.measured(np.concatenate([best, np.flatnonzero(open_)]), q[i], top)
            out.append((np.full(len(best), q_ids[i]), self.ids[best], exact))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal (list, block, is_query)."""
    for batch in batches:
        if len(batch):
            key = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("list", "block", "is_query")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield tuple(key[:, a].tolist()), batch.slice(a, b - a)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, part: int = RERANK_PART) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest rows found for each query, by Euclidean distance."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    folder = storage.work_dir(spark, "additive")
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id", "embedding").limit(SAMPLE).collect()  # a top-k of fixed size
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = np.array([r["embedding"] for r in sample])
    books = fit_codebooks(fitted)
    visits = lists_to_visit(fitted, books[0], top)
    index = build_index(rows, books, folder)
    sizes = np.zeros(len(books[0]), np.int64)
    for r in index.groupBy("list").count().collect():  # at most WORDS rows
        sizes[r["list"]] = r["count"]
    blocks = -(-sizes // BLOCK_ROWS)
    of_list = F.element_at(F.lit(blocks.tolist()), F.col("list") + 1)
    block = F.pmod(F.xxhash64("vec_id", "embedding"), of_list).cast("int").alias("block")
    placed = index.select("list", block, F.lit(0).alias("is_query"), "vec_id", "embedding", "codes", "norm", "error")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                order = lists_by_distance(_matrix(batch.column(1)), books[0])
                # a query goes on until its lists hold enough rows that are not its own
                enough = (np.cumsum(sizes[order], axis=1) < batch.column(2).to_numpy()[:, None] + top).sum(1) + 1
                lists = [o[: max(visits, n)].astype(np.int32) for o, n in zip(order, enough, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "embedding", "lists"])

    def visit_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                last = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]  # of all rows found, or infinite
                may = ~(list_bounds(x, books[0]) > last * (1 + 1e-9))
                lists = [np.setdiff1d(np.flatnonzero(m), seen).astype(np.int32) for m, seen in zip(may, batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "embedding", "lists"])

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    query_rows = rows.join(asked, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("own"))
    of = query_rows.schema["embedding"].dataType.simpleString()
    visiting_schema = f"vec_id long, embedding {of}, lists array<int>"
    every_block = F.explode(F.sequence(F.lit(0), of_list.cast("int") - 1)).alias("block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell, block = None, None
        for (of_list, number, is_query), rows_here in _cells(batches):
            if (of_list, number) != cell:
                cell, held, block = (of_list, number), [], None
            if not is_query:
                held.append(rows_here)
                continue
            if held and block is None:
                block = IndexBlock(held, books)
            for i in range(0, len(rows_here) if block is not None else 0, QUERY_ROWS):
                some = rows_here.slice(i, QUERY_ROWS)
                yield block.search(some.column("vec_id").to_numpy(), _matrix(some.column("embedding")), top, part)

    def found_in(visiting: DataFrame, among: DataFrame) -> DataFrame:
        """query_id, vec_id, score: the nearest rows in each visited block of the index rows ``among``."""
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("codes", "binary"), ("norm", "double"), ("error", "double"))]
        cells = visiting.select("vec_id", "embedding", F.explode("lists").alias("list")).filter(of_list > 0).select("list", every_block, F.lit(1).alias("is_query"), "vec_id", "embedding", *none)
        dealt = among.unionByName(cells).repartition(max(1, int(blocks.sum())), "list", "block").sortWithinPartitions("list", "block", "is_query")
        return dealt.mapInArrow(search, FOUND)

    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best_of = lambda found: found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    visiting = storage.written(query_rows.mapInArrow(visit, visiting_schema), f"{folder}/visiting")
    first = storage.written(best_of(found_in(visiting, placed)), f"{folder}/first")
    last = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == top, F.max("score")).otherwise(float("inf")).alias("last"))
    going_on = visiting.filter(F.size("lists") < len(books[0])).join(last, "vec_id", "left").select("vec_id", "embedding", "lists", F.coalesce("last", F.lit(float("inf"))).alias("last"))
    rest = storage.written(going_on.mapInArrow(visit_rest, visiting_schema).filter(F.size("lists") > 0), f"{folder}/rest")
    open_lists = [r["list"] for r in rest.select(F.explode("lists").alias("list")).distinct().collect()]  # at most WORDS rows
    if not open_lists:
        return first
    again = found_in(rest, placed.filter(F.col("list").isin(open_lists)))
    return best_of(first.drop("rank").unionByName(again))
