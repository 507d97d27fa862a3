"""Plans stay small, whatever is built on a matrix, and small groups keep tasks of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import evaluation, models, network, temporal
from crestline.plans import bindings as b
from crestline.plans import studies
from crestline.sources import sinks

DATA = "/root/testdata/sf0.001"


def size_of(df) -> int:
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_matrices_hold_nothing_of_how_they_were_made(spark):
    for rows in (b.features(spark, DATA), b.full_matrix(spark, DATA)):
        assert size_of(rows) < 10_000
    assert size_of(studies.ablation(rows, studies.ARMS[:2], base="volume_only", rounds=1)) < 100_000


def test_settled_rows_are_the_rows(spark):
    df = spark.range(7).select("id", F.rand(1).alias("r"))
    kept = sinks.settled(df)
    assert kept.schema == df.schema and sorted(kept.collect()) == sorted(df.collect())


def test_equal_rows_count_as_often_as_they_occur():
    rng = np.random.default_rng(3)
    x = rng.poisson(1.5, (3000, 2)).astype(float)
    y = (x[:, 0] + rng.normal(size=3000) > 2).astype(int)
    fitted = models.BoostedTrees(rounds=20).fit(x, y)
    sizes = []
    own = models.BoostedTrees(rounds=1)
    own._grow = lambda bins, g, h, times: sizes.append((bins.shape[1], times.sum())) or (None, None)
    own.fit(x, y)
    assert sizes[0] == (len(np.unique(np.c_[own._bins(x).T, y], axis=0)), 3000) and sizes[0][0] < 200
    # the first tree's root: the mean step over all rows, each once
    weight = np.where(y == 1, 3000 / (2 * y.sum()), 3000 / (2 * (3000 - y.sum())))
    assert fitted.trees[0][0][4] == pytest.approx(-0.1 * (weight * (0.5 - y)).sum() / (weight * 0.25).sum(), abs=1e-12)
    p = fitted.predict(x)
    for row in np.unique(x, axis=0):
        assert len(set(p[(x == row).all(1)])) == 1
    first, times, place = models.same_columns(np.array([[1, 2, 1, 0], [5, 5, 5, 5]], np.uint8))
    assert (first.tolist(), times.tolist(), place.tolist()) == ([0, 1, 3], [2, 1, 1], [0, 1, 0, 2])


def test_bootstrap_is_that_of_drawn_rows_and_arms_have_their_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(a, f"k{i:03d}", int(rng.random() < 0.3), float(rng.integers(0, 9)) / 9) for a in "uvw" for i in range(80)]
    got = evaluation.bootstrap_ci(spark.createDataFrame(rows, "arm string, key string, label int, p double"), 50, 7)
    assert got.rdd.getNumPartitions() == evaluation.BOOT_TASKS
    for r in got.collect():
        own = sorted((k, p, y) for a, k, y, p in rows if a == r.arm)
        y, p, draw = np.array([x[2] for x in own]), np.array([x[1] for x in own]), np.random.default_rng(7)
        want = [evaluation.ap_of(y[i], p[i]) for i in (draw.integers(0, 80, 80) for _ in range(50)) if 0 < y[i].sum() < 80]
        assert r.n_used == len(want) and [r.low, r.high] == pytest.approx(np.percentile(want, [2.5, 97.5]).tolist(), abs=1e-12)


def test_graphs_of_small_topics_are_spread_over_tasks(spark):
    posts = spark.createDataFrame([(f"t{i}", "a", ["b"]) for i in range(40)], "topic string, author string, targets array<string>")
    got = network.whole_graph_features(posts, ("components",))
    assert got.rdd.getNumPartitions() == sinks.spread(spark) > 1


def test_tasks_of_arima_fits_grow_with_the_series(spark, monkeypatch):
    monkeypatch.setattr(temporal, "TASK_SERIES", 2)
    rows = spark.createDataFrame([(f"t{i}", [0, 1, 0, 2, 1, 0, 3, 1, 0, i % 3]) for i in range(40)], "topic string, history array<long>")
    got = temporal.arima_features(rows)
    assert got.rdd.getNumPartitions() == 20 and got.count() == 40


def test_replicates_fit_equal_rows_once(spark):
    from crestline import config

    rng = np.random.default_rng(6)
    drawn = [(f"t{i:03d}", int(rng.random() < 0.4), *(float(v) for v in rng.integers(0, 2, 3))) for i in range(300)]
    arm, columns = config.Arm("volume_only", ("volume_baseline",)), config.FEATURE_SETS["volume_baseline"]
    rows = spark.createDataFrame(drawn, f"topic string, label int, {', '.join(f'{c} double' for c in columns)}")
    topics, labels, x = [r[0] for r in drawn], np.array([r[1] for r in drawn]), np.array([r[2:] for r in drawn])
    for shuffled in (False, True):
        got = models.replicated_scores(rows, arm, 3, [42, 43], shuffled, rounds=5).toPandas()
        for rep in (0, 1):
            y = labels.copy()
            if shuffled:
                y[models._places(topics, "")] = labels[models._places(topics, str(42 + rep) if rep else "")]
            fold, p = models._dealt_folds(topics, y, 3, str(42 if shuffled else 42 + rep)), np.zeros(300)
            for test in range(3):
                p[fold == test] = models.Fitted(arm, x[fold != test], y[fold != test], rounds=5).predict(x[fold == test])
            own = got[got.rep == rep]
            assert sorted(zip(own.label.repeat(own.n), own.p.repeat(own.n), strict=True)) == sorted(zip(y, p, strict=True))
            assert len(own) <= 2 * 3 * len(np.unique(x, axis=0)) < 300


def test_quantiles_and_curves_count_rows(spark):
    rng = np.random.default_rng(7)
    x, n, q = rng.normal(size=50), rng.integers(1, 90, 50), np.linspace(0, 1, 256)
    assert models.quantiles(x, q, n).tolist() == np.quantile(np.repeat(x, n), q).tolist()
    once = spark.createDataFrame([("a", 1, 0.9, 3), ("a", 0, 0.9, 1), ("a", 1, 0.2, 2), ("a", 0, 0.1, 4)], "arm string, label int, p double, n long")
    long = once.select("arm", "label", "p", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).drop("i")
    for score in (evaluation.average_precision, evaluation.roc_auc, evaluation.threshold_metrics):
        assert score(once).collect() == score(long).collect()


def test_forests_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(models, "FOREST_ROWS", 50)
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(f"t{i:03d}", i % 2, float(rng.normal() + i % 2), float(rng.normal())) for i in range(300)], "topic string, label int, a double, b double")
    assert models.in_order(rows, 300).rdd.getNumPartitions() == 6
    scores = [{r.topic: r.p for r in models.random_forest_scores(rows.repartition(n, F.rand(n)), ["a", "b"], 2, 5).collect()} for n in (1, 7)]
    assert scores[0] == scores[1] and len(scores[0]) == 300
    shares = [models.impurity_importance(rows.repartition(n, F.rand(n)), ["a", "b"], 5).collect() for n in (1, 7)]
    assert shares[0] == shares[1]


def test_importance_scores_rows_that_got_another_bin(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(f"t{i:03d}", i % 2, float(rng.normal() + i % 2), float(rng.random() < 0.05)) for i in range(300)], "topic string, label int, a double, b double")
    got = {r.feature: r for r in models.permutation_importance(rows, ["a", "b"], 4, 7, rounds=8).collect()}
    dealt = evaluation.fold_assignment(rows, "topic", 10).toPandas().sort_values("topic")
    x, y, held = dealt[["a", "b"]].to_numpy(), dealt.label.to_numpy(), dealt.fold.to_numpy() < 3
    known = models.BoostedTrees(rounds=8).fit(x[~held], y[~held])
    for at, name in enumerate("ab"):
        draw, bins, lost = np.random.default_rng(7), known._bins(x[held]), []
        for _ in range(4):
            shuffled = bins.copy()
            shuffled[at] = draw.permutation(shuffled[at])
            lost.append(evaluation.ap_of(y[held], known._predict(bins)) - evaluation.ap_of(y[held], known._predict(shuffled)))
        assert (got[name].importance, got[name].spread) == (np.mean(lost), np.std(lost))


def test_whole_graphs_go_to_python_without_pandas(spark):
    posts = spark.createDataFrame([("t", "a", ["b"]), ("t", "b", ["c"]), ("s", "a", [])], "topic string, author string, targets array<string>")
    whole = network.whole_graph_features(posts)
    assert "FlatMapGroupsInArrow" in whole._jdf.queryExecution().executedPlan().toString()
    want = {"t": network.graph_numbers(["a", "b", "b", "c"], [("a", "b"), ("b", "c")]), "s": network.graph_numbers(["a"], [])}
    assert {r.topic: {c: v for c, v in r.asDict().items() if c != "topic"} for r in whole.collect()} == want
