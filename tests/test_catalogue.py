"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from crestline.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ("clean_topic", "dedup_id_topic", "leak_anti_join", "leak_excluded", "window_language_mix", "unit_sentiment", "feature_matrix", "graph_components", "fold_assignment", "units", "attrition", "censor_validation", "unit_sweep", "window_posts", "graph_clustering", "sent_aggregate", "avg_precision", "roc_auc", "mcnemar")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, duck, name):
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_model_queries_run_at_the_operators_defaults(monkeypatch):
    from types import SimpleNamespace

    from crestline import config

    seen = {}

    def noted(name):
        def f(*args, **settings):
            seen[name] = (args[1:], settings)

        return f

    monkeypatch.setattr(catalogue, "rounded", lambda df: df)
    monkeypatch.setattr(catalogue.b, "full_matrix", lambda s, d: SimpleNamespace(columns=[c for own in config.FEATURE_SETS.values() for c in own]))
    for module, name in ((catalogue.models, "oof_scores"), (catalogue.models, "permutation_importance"), (catalogue.studies, "language_control")):
        monkeypatch.setattr(module, name, noted(name))
    for query in ("gbt_oof", "permutation_importance", "language_control"):
        catalogue.queries()[query](None, DATA)
    assert seen["oof_scores"][0] == ()  # all arms
    (columns,) = seen["permutation_importance"][0]
    assert columns == [c for k in ("volume_baseline", "structure_size_free", "sentiment", "temporal") for c in config.FEATURE_SETS[k]]
    assert all(settings == {} for _, settings in seen.values()) and seen["language_control"][0] == (DATA,)


def test_the_leak_guard_lets_some_through(spark):
    assert catalogue.queries()["leak_anti_join"](spark, DATA).count() > 0 and catalogue.queries()["leak_excluded"](spark, DATA).first()["n_excluded"] > 0


def test_the_full_matrix_has_every_set(spark):
    from crestline import config

    rows = catalogue.b.full_matrix(spark, DATA)
    assert rows.count() == 4 and set(c for own in config.FEATURE_SETS.values() for c in own) <= set(rows.columns)


def test_bootstrap_ci_uses_all_resamples(spark):
    assert catalogue.queries()["bootstrap_ci"](spark, DATA).first()["n_used"] == 1000
