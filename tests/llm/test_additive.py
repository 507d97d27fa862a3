"""Additive quantisation against brute force."""

import numpy as np

from crestline.llm import additive

SCHEMA = "vec_id long, embedding array<float>, score string, codes string"


def table(spark, n=3000, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    x[50] = x[51] = x[100]  # ties
    return x, spark.createDataFrame([(i, v.tolist(), "s", "c") for i, v in enumerate(x)], SCHEMA).repartition(3)


def brute(x, q, ids, top=10):
    dist = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, dist)) if i != q][:top]
    return [(int(i), dist[i]) for i in order]


def test_recall_and_exact_scores(spark):
    x, df = table(spark)
    got = {}
    for r in additive.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        want = brute(x, q, np.arange(3000))
        hits += len({i for i, _ in want} & {i for _, i, _ in rows})
        assert [k for k, _, _ in rows] == list(range(1, 11)) and all(abs(s - np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12 for _, i, s in rows)
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
    assert hits / (10 * len(got)) >= 0.95
    assert [i for _, i, _ in got[100][:2]] == [50, 51]


def test_beam_beats_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    books = additive.fit_codebooks(x, m=4, k=16)
    error = lambda beam: ((x - additive.approximate(additive.beam_encode(x, books, beam), books)) ** 2).sum()
    assert error(8) < error(1) < (x**2).sum()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a", "b"), (1, [0.0, 1.0], "a", "b"), (2, None, "a", "b"), (3, [nan, 1.0], "a", "b"), (4, [0.0, 0.0], None, None), (5, [inf, 1.0], "a", "b"), (6, [None, 1.0], "a", "b"), (7, [1.0], "a", "b"), (None, [1.0, 1.0], "a", "b"), (8, [], "a", "b"), (0, [1.0, 0.0], "a", "b"), (9, [1.0, 3.0], "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id) for r in additive.nearest(df, df.filter("vec_id % 3 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 9), (9, 1, 1), (9, 2, 0), (9, 3, 0)]
    assert additive.nearest(df.limit(0), df.limit(0)).count() == 0


def test_clusters_need_few_lists_and_even_spread_most():
    rng = np.random.default_rng(3)
    centres = 6 * rng.normal(size=(32, 16))
    clustered = centres[rng.integers(0, 32, 4000)] + rng.normal(size=(4000, 16))
    even = rng.normal(size=(4000, 16))
    visits = [additive.lists_to_visit(x, additive.fit_codebooks(x, m=1, k=64, rounds=0)[0], 10) for x in (clustered, even)]
    assert visits[0] < 24 < visits[1]


def test_recall_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(additive, "BLOCK_ROWS", 40)
    x, df = table(spark, n=2500, d=24, seed=5)
    got = {}
    for parts in (1, 7):
        rows = additive.nearest(df.repartition(parts), df.filter("vec_id % 50 = 0")).collect()
        got[parts] = sorted((r.query_id, r.rank, r.vec_id) for r in rows)
        hits = sum((i in {j for j, _ in brute(x, q, np.arange(2500))}) for q, _, i in got[parts])
        assert len(rows) == 500 and hits / 500 >= 0.95
    assert got[1] == got[7]


def test_doubles_are_measured_as_doubles(spark):
    rows = [(i, [1.0 + i * 1e-9, 1.0], "a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in additive.nearest(df, df.filter("vec_id = 10")).collect()}
    assert got[10, 1][0] == 9 and got[10, 2][0] == 11 and abs(got[10, 1][1] - 1e-9) < 1e-15


def test_every_query_gets_enough_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist(), "a", "b") for i in range(13)] + [(3, [0.5, 0.5, 0.5, 0.5], "a", "b")] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    got = additive.nearest(df, df).groupBy("query_id").count().collect()
    assert len(got) == 13 and all(r["count"] == 10 for r in got)


def test_nothing_is_missed_when_the_sample_says_little(spark, monkeypatch):
    """Rows of many scales: the codewords follow the few large ones, and the sample holds few rows of all."""
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(4000, 24)) * 10.0 ** rng.uniform(-3, 3, size=(4000, 1))).astype(np.float32)
    x[3000:] = 5 + 0.01 * rng.normal(size=(1000, 24))
    monkeypatch.setattr(additive, "SAMPLE", 256)
    monkeypatch.setattr(additive, "PROBED", 0.5)
    df = spark.createDataFrame([(i, v.tolist(), "s", "c") for i, v in enumerate(x)], SCHEMA).repartition(3)
    got = {}
    for r in additive.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, rows in got.items():
        assert [i for _, i in sorted(rows)] == [i for i, _ in brute(x, q, np.arange(4000))]
    assert len(got) == 80


def test_list_bounds_hold():
    rng = np.random.default_rng(12)
    words, x, q = rng.normal(size=(12, 5)), rng.normal(size=(3000, 5)), rng.normal(size=(20, 5))
    own, bounds = additive.lists_by_distance(x, words)[:, 0], additive.list_bounds(q, words)
    for i in range(20):
        distance = np.sqrt(((x - q[i]) ** 2).sum(-1))
        assert (distance >= bounds[i][own]).all()
    assert (bounds > 0).any()
