"""Quality rules: statistics of each text, two fixed rules, and an isolation forest on the statistics.

The forest is fitted on at most ``SAMPLE`` labelled documents, those with the smallest hash of doc_id. Its
trees split a random statistic at a random place; an unusual document is alone after few splits, and its
mean path length gives a score between 0 and 1. A statistic is drawn the more often the further good and bad
rows of the sample lie apart in it (the square of the largest distance of their distribution functions), so
that what is rare but harmless isolates few; ``FLOOR`` leaves every statistic a chance. Trees are
of few rows, or junk of one kind would hide itself by its number. The threshold comes
from every labelled document: scores are counted in ``BINS`` bins for good and bad documents, and the cut is
the lowest one that keeps at least ``KEEP_GOOD`` of the good. Without labels of both kinds nothing is rejected but by the fixed rules.

The driver gets the sample and the two histograms, whose sizes do not grow with the input.

Cases: a null text has no words and fails the fixed rules; a null doc_id is carried and has no label;
repeated rows are judged alike; doc_ids that are labelled more than once count with their lowest quality;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, storage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

SAMPLE = 4096
TREES, TREE_ROWS, DEPTH = 200, 32, 10
BINS = 2000
KEEP_GOOD = 0.999
FLOOR = 0.01
SEED = 20

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_digits", "n_marks", "n_lines", "n_types")
STATS = "doc_id long, " + ", ".join(f"{x} long" for x in RULES + MORE)
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    if len(numbers) < 2_000_000:
        keys = (ids[:-2] * len(numbers) + ids[1:-1]) * len(numbers) + ids[2:]
    else:  # beyond 63 bits
        _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
        keys = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    windows = np.zeros(n - 2, bool)
    windows[order[1:][same]] = True
    windows[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= windows
    return int(covered.sum())


def statistics(text: str) -> tuple[int, ...]:
    """The numbers named in RULES and MORE."""
    raw = text.encode()
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    fewer = lambda table: len(raw) - len(raw.translate(None, table))
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), fewer(_UPPER), fewer(_DIGITS), fewer(_MARKS), lines, len(set(words)))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()  # of a query that this worker ran before
        storage.give_back()
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(RULES + MORE)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *RULES, *MORE])
        storage.give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, STATS)


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics as shares of the text's size: nothing is clipped.

    Words (logarithm), characters a word, symbols a word, repeated lines a line, words in repeated windows
    a word, capitals and digits a character, marks a word, and distinct words against all (logarithms).
    """
    c = {k: v.astype(float) for k, v in columns.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [np.log(words), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words]
        + [c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, np.log(c["n_types"] + 1) / np.log(words + 1)],
        axis=1,
    )


def separation(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of each statistic, the largest distance between the distribution functions of good and bad rows."""
    out = np.zeros(rows.shape[1])
    if good.any() and not good.all():
        for j, x in enumerate(rows.T):
            at = np.unique(x)
            share = lambda own: np.searchsorted(np.sort(own), at, "right") / len(own)
            out[j] = np.abs(share(x[good]) - share(x[~good])).max()
    return out


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits; ``scores`` are near 1 for rows that are isolated early.

    Among the statistics that differ in a node, one is drawn in proportion to ``weights``.
    """

    def __init__(self, rows: np.ndarray, weights: np.ndarray, seed: int = SEED, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH):
        rng = np.random.default_rng(seed)
        self.weights = weights
        self.norm = float(mean_path(min(tree_rows, len(rows))))
        self.trees = [self._grow(rows[rng.choice(len(rows), min(tree_rows, len(rows)), replace=False)], depth, rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        size = 2 ** (depth + 1) - 1
        feature, cut, path = np.full(size, -1), np.zeros(size), np.zeros(size)
        stack = [(0, rows, 0)]
        while stack:
            at, own, level = stack.pop()
            low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(1), np.zeros(1))
            open_to = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(open_to):
                path[at] = level + mean_path(len(own))
                continue
            chance = self.weights[open_to]
            f = int(rng.choice(open_to, p=chance / chance.sum()))
            feature[at], cut[at] = f, rng.uniform(low[f], high[f])
            left = own[:, f] < cut[at]
            stack += [(2 * at + 1, own[left], level + 1), (2 * at + 2, own[~left], level + 1)]
        return feature, cut, path

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            live = every
            while len(live):
                f = feature[at[live]]
                inner = f >= 0
                live, f = live[inner], f[inner]
                at[live] = 2 * at[live] + np.where(rows[live, f] < cut[at[live]], 1, 2)
            total += path[at]
        return 2.0 ** -(total / len(self.trees) / max(self.norm, 1e-9))


class Verdict:
    """A fitted forest with its threshold; without a forest only the fixed rules hold."""

    def __init__(self, forest: IsolationForest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def anomaly(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return self.forest.scores(features(columns)) if self.forest else np.zeros(len(columns["n_words"]))

    def failed(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        n = columns["n_words"]
        return (n < MIN_WORDS) | (100 * columns["n_repeat_words"] > MAX_REPEAT_PERCENT * n)

    def kept(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return ~self.failed(columns) & (self.anomaly(columns) < self.threshold)


def threshold_of(good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The lowest cut between bins below which ``keep_good`` of the good lie; above 1 without both kinds."""
    if not good.sum() or not bad.sum():
        return 2.0
    kept = np.cumsum(good)
    at = int(np.searchsorted(kept, math.ceil(keep_good * kept[-1])))
    return (at + 1) / len(good)


def fit(stats: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> Verdict:
    """Fit the forest on a bounded sample of labelled rows and the threshold on all of them.

    Documents that the fixed rules reject take no part in either.
    """
    once = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("long").alias("quality"))
    passing = stats.filter(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    labelled = passing.join(once, "doc_id")
    names = [*RULES, *MORE]
    # a top-k of fixed size
    sample = labelled.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", *names).limit(SAMPLE).select(*names, "quality").collect()
    if len(sample) < 2:
        return Verdict(None, 2.0)
    rows = features({n: np.array([r[n] for r in sample], np.int64) for n in names})
    forest = IsolationForest(rows, separation(rows, np.array([r["quality"] > 0 for r in sample])) ** 2 + FLOOR)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            at = np.clip((forest.scores(features(columns)) * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(at)], names=["quality", "bin"])

    counts = labelled.select(*names, "quality").mapInArrow(bins, "quality long, bin long").groupBy("quality", "bin").count()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in counts.collect():  # at most BINS rows for each label
        (good if r["quality"] else bad)[r["bin"]] += r["count"]
    return Verdict(forest, threshold_of(good, bad, keep_good))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five rule statistics, base_failed, kept, and the forest's score."""
    spark = docs.sparkSession
    stats = storage.written(document_statistics(docs), storage.work_dir(spark, "quality"))
    verdict = fit(stats, labels)
    names = [*RULES, *MORE]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(n) for n in RULES), pa.array(verdict.failed(columns)), pa.array(verdict.kept(columns)), pa.array(verdict.anomaly(columns))], names=["doc_id", *RULES, "base_failed", "kept", "anomaly"])

    return stats.mapInArrow(decide, "doc_id long, " + ", ".join(f"{x} long" for x in RULES) + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that both the fixed rules and the forest keep, with all their columns."""
    stats = storage.written(document_statistics(docs), storage.work_dir(docs.sparkSession, "quality"))
    verdict = fit(stats, labels)
    at = docs.columns.index("text")
    names = [*RULES, *MORE]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        storage.give_back()
        for batch in batches:
            if not len(batch):
                continue
            rows = [statistics(t.as_py() or "") for t in batch.column(at)]
            columns = {n: np.array(c, np.int64) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
            yield batch.filter(pa.array(verdict.kept(columns)))
        storage.give_back()

    return docs.mapInArrow(keep, docs.schema)
