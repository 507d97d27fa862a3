"""Units on made-up curves: verdicts, windows that never reach the peak, de-duplication, and the sweep."""

import pytest
from pyspark.sql import functions as F

from crestline.config import Rules, Sweep
from crestline.operators import units

RULES = Rules(n_bins=96, min_topic=10, min_window=1)
# one curve for each verdict: bins and their counts
KEPT = {b: 1 + b % 2 for b in range(25, 58)} | {58: 9, 59: 11, 60: 9} | {b: 1 for b in range(61, 75)}
EARLY = {0: 8, 1: 8, 2: 8} | {b: 1 for b in range(3, 30)} | {30: 10, 31: 10, 32: 10}
LATE = {b: 1 for b in range(50, 88)} | {88: 6, 89: 12, 90: 6}
PLATEAU = {b: 1 for b in range(25, 45)} | {b: 7 for b in range(45, 80)}


@pytest.fixture(scope="module")
def posts(spark):
    rows, n = [], 0
    for topic, curve, label, lang in (("kept", KEPT, 1, "es"), ("early", EARLY, 1, "es"), ("late", LATE, 0, "es"), ("plateau", PLATEAU, 0, "es"), ("other", KEPT, 1, "en"), ("few", {61: 4}, 0, "es")):
        for b, k in curve.items():
            for _ in range(k):
                n += 1
                rows.append((n, topic, label, b, lang, f"u{n % 7}", 1000 + b))
    rows.append((*rows[0][:6], 5000))  # a later copy of the same post
    return spark.createDataFrame(rows, "event_id long, topic string, label int, bin int, lang string, author string, ts long")


@pytest.fixture(scope="module")
def judged(posts):
    return units.verdicts(units.dense_series(units.topic_bin_counts(units.dedup_posts(posts), 96, "es"), 96), RULES)


def test_verdicts(judged):
    assert {r.topic: r.reason for r in judged.collect()} == {"kept": "kept", "early": "left_censored", "late": "right_censored_no_tail", "plateau": "right_censored_no_decay", "other": "window_too_sparse", "few": "too_small"}


def test_window_ends_before_the_peak(judged):
    (u,) = units.units(judged, RULES).collect()
    assert u.window_end_bin == u.peak_bin - RULES.lead < u.peak_bin and u.window_end_bin - u.window_start_bin == RULES.window and u.window_start_bin >= 0
    assert u.n_window_tweets == sum(KEPT.get(b, 0) for b in range(u.window_start_bin, u.window_end_bin))


def test_duplicates_count_once(posts, judged):
    assert {r.topic: r.total for r in judged.collect()}["kept"] == sum(KEPT.values())
    assert units.dedup_posts(posts).filter("ts = 5000").count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_earliest_of_equal_peaks(spark, k):
    x = [0] * 20
    x[5] = x[15] = 10
    df = spark.createDataFrame([("t", 0, x, x, 20)], "topic string, label int, x array<long>, f array<long>, total long")
    width = units.smooth_width(k)
    assert units.with_peaks(df, Rules(n_bins=20, smooth=k)).first().peak_bin == 5 - width // 2


def test_attrition_adds_up(judged):
    rows = units.attrition(judged).collect()
    assert len(rows) == 12
    for label in (0, 1):
        own = sorted((r for r in rows if r.label == label), key=lambda r: r.step)
        assert own[-1].remaining == judged.filter(f"label = {label} AND reason = 'kept'").count() and sum(r.dropped for r in own) + own[-1].remaining == judged.filter(f"label = {label}").count()


def test_sweep_matches_single_settings(judged):
    from dataclasses import replace

    sweep = Sweep((10, 500), (6, 12), (10, 18))
    for r in units.unit_sweep(judged.drop("reason"), RULES, sweep).collect():
        rules = replace(RULES, min_topic=r.min_topic, lead=r.lead, window=r.window)
        assert r.pos == judged.withColumn("again", units.verdict(rules)).filter("again = 'kept' AND label = 1").count()


def test_leak_guard(spark):
    tags = spark.createDataFrame([("a",), ("b",)], "topic string")
    trending = spark.createDataFrame([("a",), ("c",)], "topic string")
    assert [r.topic for r in units.without_trending(tags, trending).collect()] == ["b"] and units.excluded_topics(tags, trending).first().n_excluded == 1


def test_rank_pick_spreads_evenly(spark):
    df = spark.range(21).select(F.lit(0).alias("label"), F.col("id").cast("string").alias("topic"), F.col("id").alias("total"))
    assert sorted(r["rank"] for r in units.rank_pick(df, "topic", "total", 5).collect()) == [0, 5, 10, 15, 20]


def test_rounding_is_to_even(spark):
    one = {20 + b: 1 for b in range(32)}
    judged = spark.createDataFrame([("t", 0, 40, 96, 3, [0] * 10 + [32] + [0] * 85, [0] * 10 + [1] + [0] * 85, "kept")], "topic string, label int, peak_bin int, total long, peak long, x array<long>, f array<long>, reason string")
    u = units.units(judged, Rules(lead=12, window=18)).first()
    assert len(one) == 32 and u.n_window_tweets_all_langs == 32 and u.feature_language_frac == 0.0312  # 0.03125


def test_first_of_each_and_matched(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "topic string, at int, v string")
    assert sorted(map(tuple, units.first_of_each(rows, "topic", ["at"]).collect())) == [("a", 1, "y"), ("b", 5, "z")]
    wanted = spark.createDataFrame([("b",)], "topic string")
    assert [r.v for r in units.matched(rows, wanted).collect()] == ["z"]
    with pytest.raises(ValueError, match="c"):
        units.matched(rows, spark.createDataFrame([("b",), ("c",)], "topic string"))


def test_units_without_posts_have_zeros_and_are_reported(spark):
    kept = spark.createDataFrame([("a", 1), ("b", 0)], "topic string, label int")
    part = spark.createDataFrame([("a", 3, 0.5)], "topic string, n long, share double")
    assert sorted(map(tuple, units.completed(kept, [part]).select("topic", "n", "share", "empty").collect())) == [("a", 3, 0.5, False), ("b", 0, 0.0, True)]


def test_units_table_comes_back(spark, judged, tmp_path):
    from crestline.sources import sinks

    found = units.units(judged, RULES)
    sinks.write_units(found, str(tmp_path / "u"))
    assert sorted(map(tuple, sinks.read_units(spark, str(tmp_path / "u")).collect())) == sorted(map(tuple, found.collect()))
    found.select("topic").write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError, match="peak_bin"):
        sinks.read_units(spark, str(tmp_path / "v"))
