"""Quality statistics against plain counting, and the forest on planted junk."""

import math
import random
import re

import numpy as np

from crestline.llm import quality

SCHEMA = "doc_id long, text string, quality string, kept string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_brute_force():
    r = random.Random(3)
    texts = ["", " ", "a b a b a b", "x\x1cy é  z", "l\n\nl\nl \n l\t"] + ["".join(r.choice(["a ", "b", " c", "\n", "#", " ", "é", "\x0b", "\x85"]) for _ in range(r.randint(0, 120))) for _ in range(500)]
    for t in texts:
        assert quality.statistics(t)[:5] == brute(t), t


def corpus(n=600):
    r = random.Random(1)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(r.randint(60, 400)))
    bad = lambda: " ".join(word() + r.choice(["###", "&&&", "|"]) for _ in range(r.randint(60, 400)))
    return [(i, bad() if i % 8 == 0 else good(), int(i % 8 != 0)) for i in range(n)]


def test_judge(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "q", "k") for i, t, _ in rows] + [(900, None, "q", "k"), (901, "", None, None), (None, rows[1][1], "q", "k"), (1, rows[1][1], "q", "k"), (902, "word " * 40000, "q", "k")], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2] + [(i, q, 0) for i, _, q in rows if i % 16 == 0] + [(None, 1, 0), (5, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows) + 5
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(by_id[i][0].kept == bool(q) for i, _, q in rows)
    assert by_id[900][0].base_failed and by_id[901][0].base_failed and by_id[902][0].base_failed and by_id[None][0].kept and [r.kept for r in by_id[1]] == [True, True]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)


def test_without_labels_only_the_rules_hold(spark):
    docs = spark.createDataFrame([(i, t, "q", "k") for i, t, _ in corpus(80)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, none).filter("kept").count() == 80
    assert quality.judge(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (5, 3))])
    scores = quality.IsolationForest(rows, np.ones(3)).scores(rows)
    assert set(np.argsort(-scores)[:5]) == set(range(500, 505))


def plain_forest(rows, weights, trees, tree_rows, depth):
    """Nested tuples of (statistic, cut, left, right) or a path length, drawn as the operator draws."""
    rng = np.random.default_rng(quality.SEED)

    def expected(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(own, level):
        spread = [j for j in range(len(weights)) if own and min(x[j] for x in own) < max(x[j] for x in own)]
        if level == depth or len(own) < 2 or not spread:
            return level + expected(len(own))
        chance = np.array([weights[j] for j in spread])
        j = int(rng.choice(spread, p=chance / chance.sum()))
        cut = rng.uniform(min(x[j] for x in own), max(x[j] for x in own))
        right = grow([x for x in own if not x[j] < cut], level + 1)  # right branches first
        return j, cut, grow([x for x in own if x[j] < cut], level + 1), right

    n = min(tree_rows, len(rows))
    forest = [grow([tuple(rows[i]) for i in rng.choice(len(rows), n, replace=False)], 0) for _ in range(trees)]

    def path(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
        return tree

    return lambda x: 2 ** -(sum(path(t, x) for t in forest) / trees / expected(n))


def test_verdicts_equal_those_of_a_plain_forest(spark):
    rows = [(i, t, q) for i, t, q in corpus(240)]
    r = random.Random(9)
    rows += [(500 + i, " ".join("".join(r.choices("etaoin", k=r.randint(2, 8))) + r.choice(["", "", "#"]) for _ in range(90)), 1) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "q", "k") for i, t, _ in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    stats = {i: quality.statistics(t) for i, t, _ in rows}
    x = {i: tuple(quality.features({n: np.array([v]) for n, v in zip(quality.RULES + quality.MORE, s, strict=True)})[0]) for i, s in stats.items()}
    passing = [(i, q) for i, _, q in rows if not quality.base_failed(stats[i][0], stats[i][4])]
    from pyspark.sql import functions as F

    order = [row.doc_id for row in docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(quality.SEED))).collect()]
    quality_of = dict(passing)
    sample = [i for i in order if i in quality_of]
    good = [quality_of[i] > 0 for i in sample]
    weights = quality.separation(np.array([x[i] for i in sample]), np.array(good)) ** 2 + quality.FLOOR
    score = plain_forest([x[i] for i in sample], weights, quality.TREES, quality.TREE_ROWS, quality.DEPTH)
    at = sorted(int(score(x[i]) * quality.BINS) for i, q in passing if q)
    threshold = (at[math.ceil(quality.KEEP_GOOD * len(at)) - 1] + 1) / quality.BINS
    for row in quality.judge(docs, labels).collect():
        assert abs(row.anomaly - score(x[row.doc_id])) < 1e-12
        assert row.kept == (row.doc_id in quality_of and score(x[row.doc_id]) < threshold)


def test_separation():
    rows = np.array([[0.0, 5.0], [1.0, 5.0], [2.0, 5.0], [3.0, 5.0]])
    assert quality.separation(rows, np.array([True, True, False, False])).tolist() == [1.0, 0.0]
    assert quality.separation(rows, np.ones(4, bool)).tolist() == [0.0, 0.0]


def test_workers_let_go_of_encoders_of_queries_before(spark, monkeypatch):
    """A Python worker is used again: what a tokenizing query left in it goes when the quality stage begins."""
    import pyarrow as pa

    from crestline.llm import bpe

    class Task:
        select = lambda self, *columns: self
        mapInArrow = lambda self, function, schema: function

    monkeypatch.setattr(bpe, "_encoders", {("json", "x"): bytearray(1 << 20)})
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two"])], names=["doc_id", "text"])
    (got,) = quality.document_statistics(Task())(iter([batch]))
    assert got.column(1).to_pylist() == [2] and not bpe._encoders
