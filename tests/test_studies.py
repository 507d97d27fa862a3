"""The studies over settings: which units each setting scores."""

import os

import pytest
from pyspark.sql import functions as F

from crestline.operators import units
from crestline.plans import bindings as b
from crestline.plans import studies

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture
def counted(monkeypatch):
    """Studies that count units instead of scoring them."""
    monkeypatch.setattr(studies, "large_enough", lambda rows, *gates: rows.limit(1).count() > 0)
    monkeypatch.setattr(studies, "matrix", lambda s, d, rules=b.RULES, language=b.LANG: units.units(units.verdicts(b.series(s, d), rules), rules))
    score = lambda rows, *a, **k: rows.agg(F.lit("n").alias("arm"), F.count(F.lit(1)).cast("double").alias("pr_auc"), *[F.lit(0.0).alias(c) for c in ("prevalence", "lift", "roc_auc")])
    monkeypatch.setattr(studies, "evaluate", score)


def test_lead_times_over_own_and_over_the_same_units(spark, counted):
    got = {r.setting: r.pr_auc for r in studies.lead_time(spark, DATA, (4, 7)).collect()}
    from dataclasses import replace

    for lead in (4, 7):
        rules = replace(b.RULES, lead=lead)
        assert got[f"lead_{lead}"] == units.units(units.verdicts(b.series(spark, DATA), rules), rules).count()
    both = units.nested_topics(units.with_peaks(b.series(spark, DATA), b.RULES), b.RULES, (4, 7)).count()
    assert {v for k, v in got.items() if k.startswith("nested_")} == ({both} if both else set())


def test_robustness_has_its_settings(spark, counted):
    got = {r.setting for r in studies.robustness(spark, DATA).collect()}
    assert {"min_window_1", "window_20", "folds_3", "folds_4", "folds_5"} <= got


def test_common_support_is_half_open(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.49), ("c", 0.99), ("d", 0.98)], "topic string, feature_language_frac double")
    assert sorted(r.topic for r in studies.common_support(rows).collect()) == ["a", "d"]


def test_gates(spark):
    rows = spark.createDataFrame([(int(i % 4 == 0),) for i in range(60)], "label int")
    assert studies.large_enough(rows) and not studies.large_enough(rows, 61, 1) and not studies.large_enough(rows, 10, 16)


def test_settings_that_share_rules_share_a_matrix(spark, counted, monkeypatch):
    asked, build = [], studies.matrix
    monkeypatch.setattr(studies, "matrix", lambda s, d, rules=b.RULES, language=b.LANG: (asked.append(rules), build(s, d, rules, language))[1])
    studies.lead_time(spark, DATA, (4, 7))
    studies.robustness(spark, DATA)
    assert [r.lead for r in asked[:2]] == [4, 7] and len(asked) == len(set(asked[:2])) + len(set(asked[2:]))
