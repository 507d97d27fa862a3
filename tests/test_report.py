"""The report over the smallest tables, and the sinks that write results."""

import json
import os

import pytest

from crestline.plans import report, studies
from crestline.sources import sinks

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_report_has_its_sections(spark, monkeypatch):
    monkeypatch.setattr(studies, "lead_time", lambda s, d, **fit: s.createDataFrame([("lead_4", "a", 0.5), ("nested_lead_4", "a", 0.25)], "setting string, arm string, pr_auc double"))
    monkeypatch.setattr(studies, "robustness", lambda s, d, **fit: s.createDataFrame([("min_window_1", "a", 0.5), ("window_12", "a", 0.75)], "setting string, arm string, pr_auc double"))
    text = report.build(spark, DATA, rounds=2)
    heads = [line for line in text.splitlines() if line.startswith("## ")]
    assert len(heads) == 11 and heads[0] == "## 1. Arms compared" and heads[-1].startswith("## 11.")
    assert "| nested_lead_4 | a | 0.25 |" in text and "| window_12 | a | 0.75 |" in text and "| full_fusion |" in text


def test_json_and_cache(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(1, "a")], "n long, v string"), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == [{"n": 1, "v": "a"}]
    with pytest.raises(ValueError, match="more than"):
        sinks.small_rows(spark.range(5), 4)
    at = str(tmp_path / "cache")
    assert sinks.extend_cache(spark, at, spark.createDataFrame([("a", 1.0)], "key string, p double")).count() == 1
    grown = sinks.extend_cache(spark, at, spark.createDataFrame([("a", 9.0), ("b", 2.0)], "key string, p double"))
    assert sorted(map(tuple, grown.collect())) == [("a", 1.0), ("b", 2.0)]
