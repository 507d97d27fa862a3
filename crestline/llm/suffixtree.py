"""Scoring texts by a probabilistic suffix tree.

Symbols are tokens: the words of a text and its end. A context is a run of tokens that stands right before a
symbol, and a text begins after an end. The root's distribution is that of all training tokens, discounted by
a constant taken from how many were seen once and twice; what that frees goes to the one symbol that stands
for all tokens never seen, the same symbol that the base has. From there the tree grows by one older token at
a time, below states only, so it holds every suffix of its states. A context is a state if training has it
``MIN_COUNT`` times and its distribution diverges from that of the context without its oldest token: the
log-likelihood that it gains over its occurrences must exceed the number of symbols that it repeats, and one.
The tests alone decide how deep a branch goes, up to ``DEPTH`` tokens: texts of one repeated word or line would
have the tree as deep as they are long, a pass over the blocks for each level. On 27 million tokens the mean
log10 probability of a held-out token is -3.43624, -3.40717, -3.40522 and -3.40515 with contexts of up to 2, 3, 4
and 5 tokens, and -3.40515 without a bound (with ``Q`` of 256); the README has what more levels cost.

A state's distribution takes one off each count and gives what that frees to the distribution of the next
shorter state: (max(n - 1, 0) + kinds * p) / total. A symbol is scored by the longest state that is a suffix
of what stands before it, and the probabilities of all symbols after it sum to one. The test takes p to the
next 1/``Q`` of a power of two.

A symbol seen once after a context says nothing beyond how many such there are, and a run of tokens is not
seen more often than a part of it. So a run goes on to be counted only while every part of it was seen twice.

Documents are written as blocks of numbered tokens. Level by level, each block asks for the distinct contexts
and pairs of context and symbol in it, in one request for each of many buckets; a bucket adds up what all
blocks say and answers each of them. A block takes part in a bucket once, so copies of a document add nothing
but a count, and a bucket holds about ``BUCKET_ROWS`` rows however large the corpus. The pairs of a context
that has more occurrences than a bucket should hold are dealt out by their symbols; there are at most
``MAX_HOT`` of these contexts, and their tests are aggregated by Spark. A block's tokens lie in a file, and so do
the places that still have a longer context to ask for; each is read by the task that works on the block.
Contexts travel as 64-bit hashes, and so do tokens until they are numbered by the first answers.

Cases: a null or empty text is its end alone; a null doc_id counts as the empty string for the split and
is carried; repeated rows are counted and scored each; an empty table gives an empty result; with no
training documents the unknown symbol is certain; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .bpe import text_steps
from .neardup import mix64

MIN_COUNT = 2
#: Levels that are asked for.
DEPTH = 3
FOLDS, HELD_FOLD = 7, 2
#: Steps to a power of two in which the test takes the shorter state's probabilities.
Q = 16
BLOCK_BYTES = 10 << 20
#: Rows that a bucket should hold, and how many contexts may be dealt out by symbol.
BUCKET_ROWS = 1 << 21
MAX_HOT = 1 << 16
#: The end of a text, and what stands before its beginning.
END = b"\n"

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BLOCKS = "block long, n_tokens long, file string"
ASKS = "bucket int, block long, payload binary"
ANSWERS = "block long, bucket int, payload binary, ctx long, total long, n long, q int"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_FOLD


def token_hash(token: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(token)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, equal places of their numbers side by side."""
    import zstandard

    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        head.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)))
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    kinds = [struct.unpack_from("<2sq", raw, 1 + 10 * i) for i in range(raw[0])]
    at, out = 1 + 10 * len(kinds), []
    for kind, n in kinds:
        dtype = np.dtype("<" + kind.decode())
        size = n * dtype.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n).T).reshape(-1).view(dtype))
        at += size
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of neighbours, without a sign; ``np.cumsum`` is the way back."""
    return np.diff(sorted_keys, prepend=np.uint64(0))


def _slim(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts.astype(np.uint64)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, which of them each key is, and a place of each."""
    import pandas as pd

    codes, distinct = pd.factorize(keys.view(np.int64))
    distinct = distinct.view(keys.dtype)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = rank[codes]
    some = np.empty(len(order), np.int64)
    some[own] = np.arange(len(keys))
    return distinct[order], own, some


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _edges(sorted_buckets: np.ndarray, buckets: int) -> list[slice]:
    at = np.searchsorted(sorted_buckets, np.arange(buckets + 1)).tolist()
    return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]


def write_blocks(docs: DataFrame, folder: str) -> DataFrame:
    """One row per block, with the file that has its documents and tokens, numbered in order of their hashes."""

    def block_of(doc_ids: list[int | None], texts: pa.Array) -> tuple[int, bytes]:
        texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: ascii_lower misreads slices
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
        words = split.flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        doc_of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        vocabulary = [w.encode() for w in words.dictionary.to_pylist()]
        if b"" in vocabulary:  # white space at a text's ends
            is_word = code != vocabulary.index(b"")
            code, doc_of = code[is_word], doc_of[is_word]
        hashes = np.fromiter(map(token_hash, [*vocabulary, END]), np.uint64, len(vocabulary) + 1)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        sizes = np.bincount(doc_of, minlength=len(texts)).astype(np.int64) + 1
        token = np.full(int(sizes.sum()), rank[-1], np.uint32)
        within = np.ones(len(token), bool)
        within[np.cumsum(sizes) - 1] = False
        token[within] = rank[code]
        # small numbers for frequent tokens, which take less room
        frequent = np.argsort(-np.bincount(token, minlength=len(order)), kind="stable").astype(np.uint32)
        number = np.empty(len(order), np.uint32)
        number[frequent] = np.arange(len(order))
        ids = np.array([x or 0 for x in doc_ids], np.int64)
        flags = np.array([(x is not None) + 2 * is_held_out(x) for x in doc_ids], np.uint8)
        return len(token), packed(steps(hashes[order]), frequent, number[token], sizes, ids, flags, number[rank[-1:]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin, end in text_steps(batch.column(1), BLOCK_BYTES):
                own = batch.slice(begin, end - begin)
                n, data = block_of(own.column(0).to_pylist(), own.column(1))
                file = storage.put(f"{folder}/tokens", f"block-{number:x}", data)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([file])], names=["block", "n_tokens", "file"])
                number += 1

    return storage.written(docs.mapInArrow(write, BLOCKS), f"{folder}/blocks")


def smoothed(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A state's probability of a symbol that it has ``n`` times and the shorter state gives ``p``."""
    return (np.maximum(n - 1, 0) + kinds * p) / total


def discount(seen_once: int, seen_twice: int) -> float:
    """What each count of the root gives up."""
    return min(0.95, max(0.05, seen_once / (seen_once + 2 * seen_twice))) if seen_once else 0.05


class Root:
    """What all blocks know of the training tokens."""

    def __init__(self, tokens: int, distinct: int, once: int, twice: int):
        self.tokens, self.distinct = tokens, distinct
        self.d = discount(once, twice)
        self.hot_from = max(BUCKET_ROWS // 4, tokens // MAX_HOT) + 1

    def probability(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, (c - self.d) / self.tokens, self.d * self.distinct / self.tokens)


class Block:
    """A block's documents and tokens."""

    def __init__(self, data: bytes):
        hashes, self.place, self.codes, self.sizes, self.doc_ids, self.flags, end = unpacked(data)
        self.sorted, self.end = np.cumsum(hashes, dtype=np.uint64), int(end[0])
        self.hashes = self.sorted[self.place]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc_of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.train = (self.flags < 2)[self.doc_of]

    def before(self, at: np.ndarray, j: int) -> np.ndarray:
        """The token ``j`` places before; what stands before a text's first token is its end."""
        return np.where(at - j >= self.starts[self.doc_of[at]], self.codes[np.maximum(at - j, 0)], self.end)

    def by_doc(self, values: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc_of if at is None else self.doc_of[at], weights=values, minlength=len(self.sizes))

    def token_asks(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        counts = np.empty(len(self.sorted), np.int64)
        counts[self.place] = np.bincount(self.codes[self.train], minlength=len(self.hashes))
        for b, own in enumerate(_edges(bucket_of(self.sorted, buckets), buckets)):
            if own.start < own.stop:
                yield b, packed(steps(self.sorted[own]), _slim(counts[own]))

    def take_tokens(self, answers: dict[int, bytes]) -> None:
        """Counts of the tokens in training, and numbers of those that were seen twice."""
        c, ids = (np.concatenate(x) for x in zip(*(unpacked(answers[b]) for b in sorted(answers)), strict=True))
        self.c, self.ids = c.astype(np.int64)[self.place], ids.astype(np.uint64)[self.place]

    def first_places(self, root: Root) -> Places:
        """All places with the root's probability; those whose last token was seen once go no further."""
        c = self.c
        p, at = root.probability(c), np.arange(len(self.codes))
        before = np.concatenate([[self.end], self.codes[:-1]]).astype(np.int64)
        before[self.starts] = self.end
        base = self.by_doc(np.log10((c + 1) / float(root.tokens + root.distinct + 1))[self.codes])
        docs = [base, self.by_doc((c > 0).astype(float)[self.codes]), np.zeros(len(self.sizes))]
        return Places(at, p[self.codes], c[self.codes], c[before], np.ones(len(at), bool), docs).going_on(self, 0)


class Places:
    """Places of a block that have a longer context to ask for, in order; what is settled is in the documents' sums.

    ``p``: the symbol's probability so far. ``own``: a bound of how often the symbol stands after the context
    asked for last, exact if that is above one; ``prior``: the same of the token before, ``exact`` if its
    context was the longest that this one's token would make. After the first level ``first`` has the totals and
    kinds of the tokens as contexts, from which ``p`` comes back; after later ones ``p`` itself is carried.
    """

    def __init__(self, at: np.ndarray, p: np.ndarray, own: np.ndarray, prior: np.ndarray, exact: np.ndarray, docs: list[np.ndarray], first: list[np.ndarray] | None = None):
        self.at, self.p, self.own, self.prior, self.exact, self.docs, self.first = at, p, own, prior, exact, docs, first

    def going_on(self, block: Block, k: int) -> Places:
        """The places with a context of k + 1 tokens that was seen often enough; the others are settled."""
        live = (self.prior >= MIN_COUNT) & (self.at - block.starts[block.doc_of[self.at]] >= k)
        gone = ~live
        self.docs[2] = self.docs[2] + block.by_doc(np.log10(self.p[gone]), self.at[gone])
        return Places(self.at[live], self.p[live], self.own[live], self.prior[live], self.exact[live], self.docs, self.first)

    def pack(self) -> bytes:
        p = [self.p.astype(np.float32)] if self.first is None else [_slim(x) for x in self.first]
        return packed(np.diff(self.at, prepend=0).astype(np.uint32), _slim(self.own), _slim(self.prior), self.exact.view(np.uint8), *self.docs, *p)

    @staticmethod
    def unpack(data: bytes, block: Block, root: Root) -> Places:
        at, own, prior, exact, base, known, score, *p = unpacked(data)
        places = Places(np.cumsum(at, dtype=np.int64), None, own.astype(np.int64), prior.astype(np.int64), exact.view(bool), [base, known, score])
        if len(p) == 1:
            places.p = p[0].astype(np.float64)
        else:
            total, kinds = (x.astype(np.int64)[block.before(places.at, 1)] for x in p)
            places.p = smoothed(places.own, total, kinds, root.probability(block.c)[block.codes[places.at]])
        return places


class Level:
    """The distinct contexts of ``k`` tokens before the places, and pairs with symbols, in the order in which they travel."""

    def __init__(self, block: Block, places: Places, k: int, buckets: int, hot_from: int):
        self.block, self.places, self.k, self.buckets = block, places, k, buckets
        at, hashes = places.at, block.hashes
        if k == 1:
            h, own, some = self._numbered_tokens(block.before(at, 1))
        else:
            h = np.zeros(len(at), np.uint64)
            for j in range(1, k + 1):
                h = mix64(h * _A + hashes[block.before(at, j)] + np.uint64(j))
            h, own, some = numbered(h)
        hot = places.exact[some] & (places.prior[some] >= hot_from)
        order = np.argsort(hot, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.h, self.total, self.n_cool = h[order], places.prior[some[order]], int(len(h) - hot.sum())
        self.context = rank[own]
        self.pairing = np.flatnonzero(places.own >= MIN_COUNT)
        keys = self.context[self.pairing] * len(hashes) + block.codes[at[self.pairing]]
        keys, self.pair_of, self.some_pair = numbered(keys)
        self.pair_context, self.symbol = keys // len(hashes), block.ids[keys % len(hashes)]
        contexts = _edges(bucket_of(self.h[: self.n_cool], buckets), buckets)
        cut = int(np.searchsorted(self.pair_context, self.n_cool))
        bounds = np.searchsorted(self.pair_context[:cut], [c.start for c in contexts] + [self.n_cool]).tolist()
        self.cool = [(c, slice(a, b)) for c, a, b in zip(contexts, bounds[:-1], bounds[1:], strict=True)]
        spread = bucket_of(mix64(self.h[self.pair_context[cut:]] ^ mix64(self.symbol[cut:])), buckets)
        order = np.argsort(spread, kind="stable")
        self.dealt = [order[e] + cut for e in _edges(spread[order], buckets)]

    def _numbered_tokens(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``numbered`` for contexts of one token: each is hashed once."""
        some = np.full(len(self.block.hashes), -1, np.int64)
        some[token] = np.arange(len(token))
        present = np.flatnonzero(some >= 0)
        h = mix64(self.block.hashes[present] + np.uint64(1))
        order = np.argsort(h)
        rank = np.empty(len(some), np.int64)
        rank[present[order]] = np.arange(len(order))
        return h[order], rank[token], some[present[order]]

    def asks(self) -> Iterator[tuple[int, bytes]]:
        block, at = self.block, self.places.at
        m = np.bincount(self.context, weights=block.train[at], minlength=len(self.h)).astype(np.int64)
        pair_n = np.bincount(self.pair_of, weights=block.train[at[self.pairing]], minlength=len(self.symbol)).astype(np.int64)
        q = np.maximum(np.round(np.log2(self.places.p[self.pairing[self.some_pair]]) * Q), -32768).astype(np.int16)
        pairs = lambda own: (_slim(self.symbol[own]), _slim(pair_n[own]), q[own])
        for b, ((contexts, own), hot) in enumerate(zip(self.cool, self.dealt, strict=True)):
            if contexts.start == contexts.stop and not len(hot):
                continue
            per = np.bincount(self.pair_context[own] - contexts.start, minlength=contexts.stop - contexts.start)
            hot_contexts, of_hot = np.unique(self.pair_context[hot], return_counts=True)
            yield b, packed(
                *(steps(self.h[contexts]), _slim(m[contexts]), _slim(per), *pairs(own)),
                *(steps(self.h[hot_contexts]), self.total[hot_contexts], _slim(of_hot), *pairs(hot)),
            )

    def take(self, answers: dict[int, bytes], hot_states: np.ndarray) -> Places:
        """The places after the answers; ``hot_states``: those among the contexts that are dealt out by symbol."""
        places = self.places
        total, kinds, n = np.zeros(len(self.h), np.int64), np.zeros(len(self.h), np.int64), np.zeros(len(self.symbol), np.int64)
        for b, ((contexts, pairs), hot) in enumerate(zip(self.cool, self.dealt, strict=True)):
            if contexts.start < contexts.stop or len(hot):
                total[contexts], kinds[contexts], n[pairs], n[hot] = unpacked(answers[b])
        if len(hot_states) and self.n_cool < len(self.h):
            h = self.h[self.n_cool :].view(np.int64)
            at = np.minimum(np.searchsorted(hot_states["ctx"], h), len(hot_states) - 1)
            same = hot_states["ctx"][at] == h
            total[self.n_cool :][same], kinds[self.n_cool :][same] = hot_states["total"][at[same]], hot_states["kinds"][at[same]]
        own = places.own
        own[self.pairing] = n[self.pair_of]
        of, kind = total[self.context], kinds[self.context]
        state = of > 0
        places.p[state] = smoothed(own[state], of[state], kind[state], places.p[state])
        beside = np.concatenate([[False], places.at[1:] == places.at[:-1] + 1])  # the token before is a place, too
        prior = np.where(beside, np.concatenate([[0], own[:-1]]), places.prior)
        prior[~state] = 0  # nothing grows but states
        first = None
        if self.k == 1:
            first = [np.zeros(len(self.block.hashes), np.int64) for _ in range(2)]
            token = self.block.before(places.at, 1)
            first[0][token], first[1][token] = of, kind
        return Places(places.at, places.p, own, prior, beside, places.docs, first).going_on(self.block, self.k)


def sum_tokens(parts: list[tuple[int, bytes]], bucket: int, buckets: int) -> tuple[list[tuple[int, bytes]], tuple[int, int, int, int]]:
    """Answers of one bucket to (block, ask), and its training tokens, distinct ones, those seen once and twice.

    A token that was seen twice gets a number of its own among all buckets, a small one if it is frequent.
    """
    asked = [unpacked(x) for _, x in parts]
    keys = np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in asked])
    _, own, _ = numbered(keys)
    c = np.bincount(own, weights=np.concatenate([n for _, n in asked])).astype(np.int64)
    ends = np.cumsum([len(h) for h, _ in asked])
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
    ids = np.where(c >= MIN_COUNT, rank * buckets + bucket + 1, 0)
    of = lambda x, h, e: _slim(x[own[e - len(h) : e]])
    out = [(block, packed(of(c, h, e), of(ids, h, e))) for (block, _), (h, _), e in zip(parts, asked, ends, strict=True)]
    return out, (int(c.sum()), int((c > 0).sum()), int((c == 1).sum()), int((c == 2).sum()))


def _pair_counts(context: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct pairs: where one stands, their counts, and which of them each row is."""
    _, own, some = numbered(mix64((context.astype(np.uint64) + np.uint64(1)) * _B ^ mix64(symbols)))
    return some, np.bincount(own, weights=n, minlength=len(some)).astype(np.int64), own


def state_test(total: np.ndarray, context: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each context is a state, and its number of kinds, from its pairs that were seen twice or more."""
    repeats = np.bincount(context, minlength=len(total))
    kinds = total - np.bincount(context, weights=n - 1, minlength=len(total)).astype(np.int64)
    p = np.exp2(q / Q)
    of, kind = np.maximum(total, 1), np.maximum(kinds, 1)
    gain = np.bincount(context, weights=n * np.log((n - 1 + kind[context] * p) / (of[context] * p)), minlength=len(total)) + (kinds - repeats) * np.log(kind / of)
    return (total >= MIN_COUNT) & (gain > np.maximum(repeats, 1)), kinds


def sum_level(parts: list[tuple[int, bytes]]) -> tuple[list[tuple[int, bytes]], tuple[np.ndarray, ...]]:
    """Answers of one bucket to (block, ask), and the repeated pairs of the contexts dealt out by symbol."""
    asked = [unpacked(x) for _, x in parts]

    def joined(first: int) -> tuple[np.ndarray, ...]:
        keys = np.concatenate([np.cumsum(a[first], dtype=np.uint64) for a in asked])
        symbols = np.concatenate([a[first + 3] for a in asked]).astype(np.uint64)
        m, per, n, q = (np.concatenate([a[first + i] for a in asked]).astype(np.int64) for i in (1, 2, 4, 5))
        distinct, own, some = numbered(keys)
        context = np.repeat(own, per)
        some_pair, counts, own_pair = _pair_counts(context, symbols, n)
        again = counts >= MIN_COUNT
        return distinct, m, some, own, counts, own_pair, context[some_pair[again]], counts[again], q[some_pair[again]]

    distinct, m, _, own, counts, own_pair, context, n, q = joined(0)
    total = np.bincount(own, weights=m, minlength=len(distinct)).astype(np.int64)
    state, kinds = state_test(total, context, n, q)
    total, kinds = np.where(state, total, 0)[own], np.where(state, kinds, 0)[own]
    counts = counts[own_pair]
    hot, hot_total, some, _, hot_counts, hot_pair, hot_context, hot_n, hot_q = joined(6)
    hot_counts = hot_counts[hot_pair]
    ends = lambda i: np.cumsum([0, *(len(a[i]) for a in asked)])
    e, f, g = ends(0), ends(3), ends(9)
    out = [(block, packed(_slim(total[e[i] : e[i + 1]]), _slim(kinds[e[i] : e[i + 1]]), _slim(counts[f[i] : f[i + 1]]), _slim(hot_counts[g[i] : g[i + 1]]))) for i, (block, _) in enumerate(parts)]
    return out, (hot.view(np.int64)[hot_context], hot_total[some][hot_context], hot_n, hot_q)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of neighbours with equal ``key``."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def exchange(asks: DataFrame, buckets: int, level: int, path: str) -> DataFrame:
    """Bring the asks of a bucket together and write its answers, and what blocks carry on."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("ctx", pa.int64()), ("total", pa.int64()), ("n", pa.int64()), ("q", pa.int32())])
        for bucket, rows in _runs(batches, "bucket"):
            parts = [(r["block"], r["payload"]) for r in rows]
            if bucket < 0:  # what a block carries on
                out, extra = parts, [np.zeros(0, np.int64)] * 4
            elif level == 0:
                out, totals = sum_tokens(parts, bucket, buckets)
                extra = [np.array([x], np.int64) for x in totals]
            else:
                out, extra = sum_level(parts)
            replies = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)]
            none = [pa.nulls(len(out), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([replies[0], pa.array([bucket] * len(out), pa.int32()), replies[1], *none], schema=schema)
            for i in range(0, len(extra[0]), 100_000):
                own = [pa.array(x[i : i + 100_000]) for x in extra]
                size = len(own[0])
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array([bucket] * size, pa.int32()), pa.nulls(size, pa.binary()), *own[:3], own[3].cast(pa.int32())], schema=schema)

    dealt = asks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    return storage.written(dealt.mapInArrow(answer, ANSWERS), path)


def hot_states(answers: DataFrame) -> np.ndarray:
    """hash, total and kinds of the states among the contexts dealt out by symbol: at most MAX_HOT rows."""
    pairs = answers.filter("ctx IS NOT NULL").select("ctx", "total", F.col("n").cast("double").alias("n"), F.pow(F.lit(2.0), F.col("q") / Q).alias("p"))
    per = pairs.groupBy("ctx").agg(F.max("total").cast("double").alias("total"), (F.max("total") - F.sum(F.col("n") - 1)).alias("kinds"), F.count(F.lit(1)).alias("repeats"))
    gain = F.sum(F.col("n") * F.log((F.col("n") - 1 + F.col("kinds") * F.col("p")) / (F.col("total") * F.col("p"))))
    tested = pairs.select("ctx", "n", "p").join(F.broadcast(per), "ctx").groupBy("ctx", "total", "kinds", "repeats").agg(gain.alias("gain"))
    kept = tested.filter(F.col("gain") + (F.col("kinds") - F.col("repeats")) * F.log(F.col("kinds") / F.col("total")) > F.col("repeats"))
    rows = [(r["ctx"], int(r["total"]), int(r["kinds"])) for r in kept.select("ctx", "total", "kinds").collect()]
    return np.array(sorted(rows), np.dtype([("ctx", "<i8"), ("total", "<i8"), ("kinds", "<i8")]))


def _asks_batch(number: int, asks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in asks], pa.int32()), pa.array([number] * len(asks), pa.int64()), pa.array([x for _, x in asks], pa.binary())], names=["bucket", "block", "payload"])


def _ask_tokens(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _asks_batch(row["block"], list(Block(storage.get(row["file"])).token_asks(buckets)))


def _ask(k: int, root: Root, buckets: list[int], states: np.ndarray | None, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the answers to level k - 1, carry the places on, and ask for level k."""
    for number, rows in _runs(batches, "block"):
        block = Block(storage.get(rows[0]["payload"].decode()))
        answers: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
        for r in rows[1:]:
            answers[r["level"]][r["bucket"]] = r["payload"]
        carried = next((x for b, x in answers[1].items() if b < 0), None)
        block.take_tokens(answers[0])
        places = Places.unpack(storage.get(carried.decode().partition(" ")[2]), block, root) if carried is not None else block.first_places(root)
        if k > 1 and len(places.at):
            places = Level(block, places, k - 1, buckets[k - 1], root.hot_from).take(answers[1], states)
        if k > 1 or not len(places.at):
            file = storage.put(f"{folder}/places-{k}", f"block-{number:x}", places.pack())
            yield _asks_batch(number, [(-1 - number % buckets[0], f"{len(places.at)} {file}".encode())])
        if len(places.at) and k < len(buckets):
            yield _asks_batch(number, list(Level(block, places, k, buckets[k], root.hot_from).asks()))


def _score(root: Root, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _runs(batches, "block"):
        block = Block(storage.get(rows[0]["payload"].decode()))
        block.take_tokens({r["bucket"]: r["payload"] for r in rows if r["level"] == 0})
        places = Places.unpack(storage.get(rows[-1]["payload"].decode().partition(" ")[2]), block, root)
        base, known, score = places.docs
        score = score + block.by_doc(np.log10(places.p), places.at)
        ids, every = pa.array(block.doc_ids, mask=block.flags % 2 == 0), np.full(len(block.sizes), root.tokens, np.int64)
        columns = [ids, pa.array(block.flags >= 2), *map(pa.array, (block.sizes, known.astype(np.int64), every, base, score))]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    folder = storage.work_dir(spark, "suffixtree")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = write_blocks(rows, folder)
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    if not size["blocks"]:
        return spark.createDataFrame([], SCORES)
    buckets = -(-size["tokens"] // BUCKET_ROWS)

    def with_answers(*levels: DataFrame) -> DataFrame:
        """Blocks, each followed by what it got from each of ``levels``."""
        out = blocks.select("block", F.lit(-1).alias("level"), F.lit(0).alias("bucket"), F.col("file").cast("binary").alias("payload"))
        for k, level in enumerate(levels):
            out = out.unionByName(level.filter("block IS NOT NULL").select("block", F.lit(k).alias("level"), "bucket", "payload"))
        return out.repartition(size["blocks"], "block").sortWithinPartitions("block", "level", "bucket")

    tokens = exchange(blocks.mapInArrow(partial(_ask_tokens, buckets), ASKS), buckets, 0, f"{folder}/level-0")
    of = tokens.filter("ctx IS NOT NULL").agg(*(F.sum(x).alias(x) for x in ("ctx", "total", "n", "q"))).first()
    root = Root(of["ctx"], of["total"], of["n"], of["q"])
    answers, states, k, dealt = spark.createDataFrame([], ANSWERS), None, 0, [buckets]
    while True:
        storage.release(spark)
        k += 1
        if k <= depth:
            dealt.append(buckets)
        known = with_answers(tokens, answers)
        answers = exchange(known.mapInArrow(partial(_ask, k, root, dealt, states, folder), ASKS), buckets, k, f"{folder}/level-{k}")
        del known  # or its shuffle files would outlive the next release
        if k > 1:
            for done in ("level", "places"):
                storage.drop_dir(spark, f"{folder}/{done}-{k - 1}")
        if k > depth or not answers.filter("bucket >= 0").limit(1).count():
            break
        states = hot_states(answers)
        if k > 1:  # a level asks for no more places than the one before
            live = answers.filter("bucket < 0").agg(F.sum(F.substring_index(F.col("payload").cast("string"), " ", 1).cast("long"))).first()[0]
            buckets = max(1, -(-live // BUCKET_ROWS))
    storage.release(spark)
    return with_answers(tokens, answers.filter("bucket < 0")).mapInArrow(partial(_score, root), SCORES)
