"""Graphs, curves, sentiment, metrics and models on small fixtures with known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline import config
from crestline.operators import evaluation, models, network, sentiment, temporal

CHAIN = [("ana", "eli"), ("bo", "eli"), ("cy", "eli"), ("eli", "fay")]
RING = [(f"v{i}", f"v{j}") for i in range(5) for j in range(5) if i != j]


def numbers(arcs):
    return network.graph_numbers([v for e in arcs for v in e], arcs)


def posts_of(spark, arcs):
    return spark.createDataFrame([(i, "t", i % 6, a, [b]) for i, (a, b) in enumerate(arcs)], "event_id long, topic string, bin int, author string, targets array<string>")


def test_a_chain_and_all_pairs_of_five(spark):
    chain, ring = numbers(CHAIN), numbers(RING)
    assert chain["max_core"] == 1 and chain["n_components"] == 1 and ring["max_core"] == 4 and ring["core2_frac"] == 1 and ring["max_betweenness"] == 0
    d = network.degrees(posts_of(spark, CHAIN)).first()
    assert (d.max_in_degree, d.max_out_degree, d.n_nodes, d.n_edges) == (3, 1, 5, 4) and network.reciprocity(posts_of(spark, CHAIN)).first().reciprocity == 0
    assert network.reciprocity(posts_of(spark, RING)).first().reciprocity == 1 and network.clustering(posts_of(spark, RING)).first().mean_clustering == 1


def test_two_triangles_and_a_path():
    triangles = numbers([("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "r"), ("r", "p")])
    assert triangles["n_communities"] == 2 and triangles["largest_community_frac"] == 0.5 and triangles["modularity"] == pytest.approx(0.5) and triangles["core2_frac"] == 1
    # both inner vertices of a path of four lie on two of its paths
    assert numbers([("p", "q"), ("q", "r"), ("r", "s")])["max_betweenness"] == pytest.approx(2 / 6)


def test_cores_equal_plain_peeling():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (8, 10), (40, 120), (60, 400)):
        pairs = sorted({(min(x, y), max(x, y)) for x, y in rng.integers(0, n, (m, 2)).tolist() if x != y})
        near = {v: {y for x, y in pairs if x == v} | {x for x, y in pairs if y == v} for v in range(n)}
        want = np.zeros(n)
        for k in range(1, n):
            left = set(range(n))
            while low := {v for v in left if len(near[v] & left) < k}:
                left -= low
            want[list(left)] = k
        assert network.core_numbers(n, np.array([x for x, _ in pairs], int), np.array([y for _, y in pairs], int)).tolist() == want.tolist()


def test_clustering_equals_plain_counting(spark):
    rng = np.random.default_rng(6)
    arcs = [(f"n{x}", f"n{y}") for x, y in rng.integers(0, 14, (60, 2)).tolist()] + [("hub", f"n{i}") for i in range(14)]
    near = {}
    for x, y in arcs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    near = {v: s - {v} for v, s in near.items()}
    local = [sum(y in near[x] for x in s for y in s if x < y) * 2 / (len(s) * (len(s) - 1)) if len(s) > 1 else 0.0 for s in near.values()]
    assert network.clustering(posts_of(spark, arcs)).first().mean_clustering == pytest.approx(sum(local) / len(local))


def test_page_rank_sums_to_one():
    rank = network.page_rank(4, np.array([0, 1, 2]), np.array([1, 2, 0]))
    assert rank.sum() == pytest.approx(1, abs=1e-4) and rank[3] < rank[0]


def test_growth_of_a_window(spark):
    kept = spark.createDataFrame([("t", 0, 6)], "topic string, window_start_bin int, window_end_bin int")
    g = network.growth(posts_of(spark, CHAIN), kept).first()
    assert g.node_growth_slope > 0 and g.edge_node_ratio_final == pytest.approx(4 / 5) and g.new_author_frac_last_slice == 0


def shape(spark, x):
    return temporal.shape_features(spark.createDataFrame([("t", x)], "topic string, w array<long>"), len(x)).first()


def test_shapes(spark):
    up, flat = list(range(1, 19)), [10] * 18
    r = shape(spark, up)
    x = np.array(up, float) / np.mean(up)
    assert r.slope_norm == pytest.approx(np.polyfit(np.arange(18), x, 1)[0]) and r.accel_norm == pytest.approx(np.polyfit(np.arange(18), x, 2)[0], abs=1e-9) and r.bin_gini == pytest.approx(network.gini(x))
    assert shape(spark, flat).burstiness == pytest.approx(0) and shape(spark, up[::-1]).slope_norm < 0
    for k in (2, 10, 100):
        assert shape(spark, [k * v for v in up]).asDict() == pytest.approx(r.asDict())
    assert all(v == 0 for k, v in shape(spark, [0] * 18).asDict().items() if k != "topic") and shape(spark, [1, 2]).slope_norm == 0


def test_arima_recovers_a_moving_average():
    rng = np.random.default_rng(0)
    e = rng.normal(size=601)
    fit = temporal.Arima(e[1:] + 0.6 * e[:-1] + 5, (0, 0, 1))
    assert fit.ma[0] == pytest.approx(0.6, abs=0.1) and fit.variance == pytest.approx(1, abs=0.2)
    ar = np.zeros(600)
    for t in range(1, 600):
        ar[t] = 0.7 * ar[t - 1] + e[t]
    assert temporal.Arima(ar, (1, 0, 0)).ar[0] == pytest.approx(0.7, abs=0.1)
    assert temporal.arima_numbers(np.zeros(20))["meta_arima_converged"] == 0 and len(temporal.ORDERS) == 16


def test_stationarity_tests_tell_walks_from_noise():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=200)
    assert temporal.adf_rejects(noise) and not temporal.adf_rejects(np.cumsum(noise)) and temporal.kpss_p(noise) > 0.05 and temporal.kpss_p(np.cumsum(noise)) < 0.05


def test_sentiment(spark):
    keyed = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "gone")], "topic string, key string")
    cache = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 1.0, 0.0, 0.0)], "key string, p_neg double, p_neu double, p_pos double")
    r = sentiment.sentiment_features(keyed, cache).first()
    assert (r.sent_mean, r.sent_intensity, r.sent_strong_frac, r.sent_polarisation, r.meta_sent_n) == (0, 1, 1, 1, 2)
    texts = spark.createDataFrame([("t", "x"), ("t", " "), ("t", None), ("u", "x")], "topic string, text string")
    keys = sentiment.topic_texts(texts)
    assert keys.count() == 2 and sentiment.score_cache(keys, None).count() == 1
    scored = sentiment.score_cache(keys, None, sentiment.batched_scorer(lambda batch: [(0.0, 1.0, 0.0)] * len(batch))).first()
    assert scored.p_neu == 1


def test_lead_bins_stop_before_the_peak(spark):
    kept = spark.createDataFrame([("a", 80), ("b", 8)], "topic string, peak_bin int")
    got = sentiment.lead_bins(kept, (6, 12), 18).collect()
    assert {r.bin for r in got if r.topic == "a"} == set(range(50, 74)) and {r.bin for r in got if r.topic == "b"} == {0, 1}


def test_metrics_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    scores = spark.createDataFrame([("m", str(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "arm string, key string, label int, p double")
    assert evaluation.average_precision(scores).first().pr_auc == pytest.approx(evaluation.ap_of(y, p))
    d = p[y == 1][:, None] - p[y == 0][None, :]
    assert evaluation.roc_auc(scores).first().roc_auc == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())
    r = evaluation.bootstrap_ci(scores, 50).first()
    assert r.low <= r.pr_auc <= r.high


@pytest.mark.parametrize(("a", "b", "want"), [(3, 18, 0.0015), (5, 17, 0.0169), (10, 10, 1.0), (0, 0, 1.0)])
def test_mcnemar(spark, a, b, want):
    rows = [(1, 1.0, 0.0)] * a + [(1, 0.0, 1.0)] * b + [(1, 1.0, 1.0)]
    assert evaluation.mcnemar(spark.createDataFrame(rows, "label int, p_a double, p_b double")).first().p_value == pytest.approx(want, abs=5e-5)


def test_residualised_features_do_not_follow_the_proxy():
    rng = np.random.default_rng(0)
    proxy = rng.uniform(10, 500, 200)
    x = np.stack([0.02 * proxy + rng.normal(size=200), rng.normal(size=200), proxy], axis=1)
    out = models.without_volume(x, *models.volume_line(x))
    assert out.shape == (200, 2) and abs(np.corrcoef(x[:, 0], proxy)[0, 1]) > 0.5 and np.abs(np.corrcoef(out[:, 0], proxy)[0, 1]) < 1e-6


def test_boosted_trees_learn_and_repeat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    a, b = (models.BoostedTrees(rounds=60).fit(x[:300], y[:300]).predict(x[300:]) for _ in range(2))
    assert (a == b).all() and ((a > 0.5) == y[300:]).mean() > 0.85


def test_feature_sets_are_checked():
    every = [c for own in config.FEATURE_SETS.values() for c in own]
    assert len(every) == 61
    config.validate(["topic", "label", "meta_x", *every])
    for columns, sets in ((every[1:], None), ([*every, "new"], None), (every, config.FEATURE_SETS | {"sentiment": ("sent_mean", "slope_norm")}), ([*every, "n_x"], config.FEATURE_SETS | {"structure_size_free": (*config.FEATURE_SETS["structure_size_free"], "n_x")})):
        with pytest.raises(ValueError, match=":"):
            config.validate(columns, sets or config.FEATURE_SETS)
    assert config.arm_columns(config.ARMS[6])[-1] == config.VOLUME_PROXY and config.arm_columns(config.ARMS[0]) == []


@pytest.mark.parametrize("name", ["tweets_per_active_bin", "max_core", "mean_component_size", "community_entropy", "max_in_degree"])
def test_counts_are_not_size_free(name):
    sets = {k: tuple(c for c in own if c != name) for k, own in config.FEATURE_SETS.items()}
    sets["structure_size_free"] += (name,)
    with pytest.raises(ValueError, match=name):
        config.validate([c for own in sets.values() for c in own], sets)


def unit_rows(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    a, b, size = rng.normal(size=n) + 2.5 * label, rng.normal(size=n), rng.uniform(10, 90, n)
    return spark.createDataFrame([(f"t{i}", int(label[i]), float(a[i]), float(b[i]), float(size[i])) for i in range(n)], "topic string, label int, a double, b double, window_tweets double")


SETS = {"both": ("a", "b"), "noise": ("b",), "structure": ("a",)}


def test_out_of_fold_scores_equal_plain_fits(spark):
    rows = unit_rows(spark)
    arms = (config.Arm("both", ("both",)), config.Arm("chance"), config.Arm("left", ("structure",), residualise="structure"))
    got = models.oof_scores(rows, arms, sets=SETS, rounds=15).toPandas()
    plain = evaluation.fold_assignment(rows, "topic").toPandas().sort_values("topic")
    for arm in arms:
        columns = config.arm_columns(arm, SETS)
        for fold in range(5):
            test, train = plain[plain.fold == fold], plain[plain.fold != fold]
            x, z, y = train[columns].to_numpy(float), test[columns].to_numpy(float), train.label.to_numpy()
            if arm.residualise:
                line = np.polyfit(x[:, -1], x[:, 0], 1)
                x, z = x[:, :1] - np.polyval(line, x[:, -1:]), z[:, :1] - np.polyval(line, z[:, -1:])
            want = models.BoostedTrees(rounds=15).fit(x, y).predict(z) if columns else np.full(len(test), y.mean())
            own = got[(got.arm == arm.name) & (got.fold == fold)].sort_values("topic")
            assert own.topic.tolist() == test.topic.tolist() and own.p.to_numpy() == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="gone"):
        models.oof_scores(rows, (config.Arm("x", ("x",)),), sets={"x": ("a", "gone")})


def test_folds_are_dealt_in_order_of_the_hash(spark):
    import hashlib

    rows = unit_rows(spark, 400)
    got = {r.topic: r.fold for r in evaluation.fold_assignment(rows, "topic", 5, "7").collect()}
    for label in (0, 1):
        order = sorted((f"t{i}" for i in range(400) if i % 2 == label), key=lambda t: (hashlib.md5(f"{t}:7".encode()).hexdigest(), t))
        assert [got[t] for t in order] == [i % 5 for i in range(len(order))]


def test_repeats_shuffles_and_forests(spark, monkeypatch):
    from crestline.plans import studies

    rows, arm = unit_rows(spark), config.Arm("a", ("structure",))
    monkeypatch.setattr(config, "FEATURE_SETS", SETS)
    monkeypatch.setattr(models, "arm_columns", lambda a, sets=SETS: config.arm_columns(a, sets))
    cv = {r.metric: r for r in studies.repeated_cv(rows, arm, 3, rounds=10).collect()}
    assert set(cv) == {"pr_auc", "roc_auc", "f1"} and cv["roc_auc"].repeats == 3 and cv["roc_auc"].mean > 0.8 and cv["roc_auc"].spread >= 0
    good = studies.permutation_test(rows, arm, 9, rounds=10).first()
    assert good.n_as_good == 0 and good.p_value == pytest.approx(0.1)
    table = {r.arm: r for r in studies.ablation(rows, (config.Arm("signal", ("structure",)), config.Arm("noise", ("noise",))), base="noise", rounds=10).collect()}
    assert table["signal"].roc_auc > table["noise"].roc_auc and table["signal"].low <= table["signal"].pr_auc <= table["signal"].high
    assert table["signal"].n10 > table["signal"].n01 and table["noise"].n10 is None
    forest = models.random_forest_scores(rows, ["a", "b"], trees=20).toPandas()
    assert len(forest) == 60 and set(forest.fold) == set(range(5))
    d = forest[forest.label == 1].p.to_numpy()[:, None] - forest[forest.label == 0].p.to_numpy()[None, :]
    assert ((d > 0) + 0.5 * (d == 0)).mean() > 0.8
    weight = {r.feature: r.importance for r in models.impurity_importance(rows, ["a", "b"], trees=20).collect()}
    assert weight["a"] > weight["b"] and sum(weight.values()) == pytest.approx(1)


def test_audit_is_sorted_and_held_against_the_settings(spark):
    rng = np.random.default_rng(2)
    size = rng.uniform(1, 100, 80)
    rows = spark.createDataFrame([(f"t{i}", float(s), float(s * 2 + rng.normal()), float(rng.normal())) for i, s in enumerate(size)], "topic string, window_tweets double, follows double, free double")
    audit = evaluation.size_audit(rows, ["free", "follows"], "window_tweets")
    assert [r.feature for r in audit.collect()] == ["follows", "free"]
    assert evaluation.audit_differences(audit, ("free",)) == [] and evaluation.audit_differences(audit, ("free", "follows")) == ["follows"]


def test_lexicon_baseline(spark):
    texts = spark.createDataFrame([("t", "en", "Good good day"), ("t", "en", "bad"), ("t", "es", "good"), ("t", "en", "Good good day"), ("u", "es", "bad"), ("v", "en", "stone"), ("v", "en", None)], "topic string, lang string, text string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -3.0)], "word string, valence double")
    got = {r.topic: r for r in sentiment.lexicon_baseline(texts, lexicon).collect()}
    up, down = 4 / (16 + 15) ** 0.5, -3 / (9 + 15) ** 0.5
    assert got["t"].lex_n == 3 and got["t"].lex_mean == pytest.approx((2 * up + down) / 3) and got["t"].lex_var == pytest.approx(np.var([up, up, down])) and got["t"].lex_strong_frac == 1
    assert (got["u"].lex_n, got["u"].lex_mean) == (0, 0) and (got["v"].lex_n, got["v"].lex_mean) == (1, 0)
    assert sentiment.lexicon_coverage(texts).first().share == pytest.approx(5 / 7)


def test_topics_without_texts_have_zeros(spark):
    scored = spark.createDataFrame([("a", 0.5, 3)], "topic string, sent_mean double, meta_sent_n long")
    topics = spark.createDataFrame([("a",), ("b",)], "topic string")
    assert sorted(map(tuple, sentiment.completed_sentiment(scored, topics).collect())) == [("a", 0.5, 3), ("b", 0.0, 0)]


def test_window_language_mix(spark):
    posts = spark.createDataFrame([(1, "a", 1, 3, "es", 1), (1, "a", 1, 3, "es", 2), (2, "a", 1, 4, "en", 1), (3, "a", 1, 9, "es", 1), (4, "a", 1, 4, None, 1)], "event_id long, topic string, label int, bin int, lang string, ts long")
    kept = spark.createDataFrame([("a", 1, 3, 6), ("b", 0, 3, 6)], "topic string, label int, window_start_bin int, window_end_bin int")
    got = {r.topic: r for r in sentiment.window_language_mix(posts, kept, ("es", "en")).collect()}
    assert got["a"].lang_total == 3 and got["a"].lang_es == pytest.approx(1 / 3) and got["a"].lang_n_distinct == 3
    assert (got["b"].lang_total, got["b"].lang_es) == (0, 0)


def test_models_are_fitted_on_all_rows(spark):
    """An arm without features scores the share of its training rows, which tells which rows these were."""
    n = 70_001
    rows = spark.range(n).select(F.col("id").cast("string").alias("topic"), (F.hash("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 5).cast("double").alias("a"))
    arm = config.Arm("none")
    got = models.oof_scores(rows, (arm,)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.min("p").alias("low"), F.max("p").alias("high")).collect()
    total, pos = sum(r.n for r in got), sum(r.pos for r in got)
    assert total == n and all(r.low == r.high == (pos - r.pos) / (n - r.n) for r in got)
    shares = {r.p for r in models.replicated_scores(rows, arm, 5, [42]).select("p").distinct().collect()}
    assert shares == {r.low for r in got}


def test_replicates_deal_folds_as_the_engine_does(spark):
    from crestline.operators.evaluation import fold_assignment

    rows = unit_rows(spark)
    for seed in ("42", "43"):
        want = fold_assignment(rows, "topic", 5, seed).select("topic", "label", "fold").collect()
        got = models._dealt_folds([r.topic for r in want], np.array([r.label for r in want]), 5, seed)
        assert got.tolist() == [r.fold for r in want]


def test_series_fitted_together_are_fitted_each_on_its_own(monkeypatch):
    rng = np.random.default_rng(4)
    series = [rng.poisson(0.7, n).astype(float) for n in (40, 9, 25, 100, 40)] + [np.array([0.0, 0, 0, 1] * 6)]
    monkeypatch.setattr(temporal, "TOGETHER", 4)
    for order in ((0, 1, 2), (2, 0, 1), (1, 1, 0)):
        for y, got in zip(series, temporal.fit_many(series, order), strict=True):
            want = temporal.Arima(y, order)
            assert len(got.residuals) == len(y) and got.settled == want.settled
            assert [*got.ar, *got.ma, got.aic, got.bic, got.forecast] == pytest.approx([*want.ar, *want.ma, want.aic, want.bic, want.forecast], abs=1e-9)


def test_small_graphs_have_the_numbers_of_the_other_operators(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(60):
        v = int(rng.integers(1, 12))
        for _ in range(int(rng.integers(1, 30))):
            rows.append((f"t{t}", None if rng.random() < 0.1 else f"u{rng.integers(v)}", [f"u{x}" for x in rng.integers(0, v, rng.integers(0, 3))]))
    posts = spark.createDataFrame([*rows, ("none", None, ["u1"])], "topic string, author string, targets array<string>").cache()
    got = network.small_graph_features(posts.groupBy("topic").agg(F.collect_list(F.struct("author", "targets")).alias("posts"))).toPandas().set_index("topic").sort_index()
    assert got.loc["none", "tweet_count"] == 1 and not got.loc["none"].drop("tweet_count").any() and len(got) == 61
    for part in (network.degrees(posts), network.reciprocity(posts), network.clustering(posts), network.whole_graph_features(posts, ("components", "page_rank"))):
        want = part.toPandas().set_index("topic").sort_index()
        for c in set(want) & set(got):
            np.testing.assert_allclose(got.loc[want.index, c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)
    want = posts.groupBy("topic").agg(F.countDistinct("author").alias("n")).toPandas().set_index("topic").sort_index()
    assert (got.unique_users == want.n).all()
