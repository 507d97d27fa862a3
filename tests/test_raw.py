"""From two raw pools to series, on files written here."""

import csv

import pytest
from pyspark.sql import functions as F

from crestline.config import Band
from crestline.operators import prototype
from crestline.sources import raw
from crestline.sources.posts import read_pool

BAND = Band("2021-06-01", 10, 11)
HEADER = ["id", "date", "time", "language", "username", "mentions", "reply_to", "tweet"]


def names(*who):
    return "[" + ", ".join(f"{{'screen_name': '{w}', 'id': '1'}}" for w in who) + "]"


@pytest.fixture(scope="module")
def pools(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pools")
    trending = [
        ["1", "2021-06-01", "10:00:10", "es", " Ana ", names("Bo", "ana"), "[]", "one", "#Kites.csv"],
        ["1", "2021-06-01", "10:00:10", "es", "ana", "[]", "[]", "a copy", "kites"],
        ["2", "2021-06-01", "10:07:00", "en", "", names("Cy"), names("Cy", "Di"), "two", "Kites.csv"],
        ["3", "2021-06-01", "09:59:59", "es", "eve", "[]", "[]", "too early", "kites"],
        ["4", "2021-06-01", "11:59:59", "es", "eve", "[]", "[]", "last bin", "Boats"],
        ["5", "2021-06-01", "11:00:00", "es", "eve", "[]", "[]", "no topic", ""],
    ]
    tagged = [
        ["1", "2021-06-01", "10:00:00", "es", "fay", "[]", "[]", "x", "['Drums', 'KITES', 'drums']"],
        ["7", "2021-06-01", "10:20:00", "es", "gil", "[]", "[]", "y", "['drums']"],
        ["8", "2021-06-01", "10:20:00", "es", "gil", "[]", "[]", "z", "[]"],
    ]
    out = []
    for name, last, rows in (("t", "trend", trending), ("n", "hashtags", tagged)):
        with open(folder / f"{name}.csv", "w", newline="") as f:
            csv.writer(f).writerows([[*HEADER, last], *rows])
        out.append(read_pool(spark, str(folder / f"{name}.csv"), [*HEADER, last], [*HEADER, last]))
    return raw.trending_posts(out[0], BAND), raw.tagged_posts(out[1], BAND)


def test_posts_of_the_pools(pools):
    trending, tagged = pools
    got = {(r.event_id, r.text): r for r in trending.collect()}
    assert got[1, "one"].topic == "kites" and got[1, "one"].author == "ana" and got[1, "one"].targets == ["bo"] and got[1, "one"].bin == 0
    assert got[2, "two"].author is None and got[2, "two"].targets == ["cy", "di"] and got[2, "two"].bin == 1
    assert got[3, "too early"].bin is None and got[4, "last bin"].bin == 23 and (5, "no topic") not in got
    assert sorted((r.event_id, r.topic) for r in tagged.collect()) == [(1, "drums"), (1, "kites"), (7, "drums")]


def test_series_of_both_pools(pools):
    got = {(r.topic, r.label): r for r in raw.corpus_series(*pools, BAND, "es").collect()}
    assert set(got) == {("kites", 1), ("boats", 1), ("drums", 0)}  # a trending hashtag is left out
    assert got["kites", 1].x[:2] == [1, 1] and got["kites", 1].f[:2] == [1, 0] and got["kites", 1].total == 2
    assert got["drums", 0].x[0] == 1 and got["drums", 0].x[4] == 1 and len(got["drums", 0].x) == 24


def test_the_two_rules_of_the_early_study(spark):
    tags = spark.createDataFrame([("kites",), ("boats",), ("drums",)], "tag string")
    trending = spark.createDataFrame([("#kites",), ("Boats.csv",)], "trend string")
    left = lambda rule: sorted(r.tag for r in prototype.left_out(tags, trending, rule).collect())
    assert left("exact") == ["boats", "drums"] and left("cleaned") == ["drums"]


def test_early_features(spark):
    rows = [(i, "a", 1, f"u{i % 4}", [f"u{(i + 1) % 4}"], i) for i in range(40)] + [(100 + i, "b", 0, "x", ["y"], i) for i in range(5)]
    posts = spark.createDataFrame(rows, "event_id long, topic string, label int, author string, targets array<string>, ts long").withColumn("bin", F.lit(0))
    (r,) = prototype.early_features(posts, 36, 30).collect()
    assert (r.topic, r.total_count, r.tweet_count, r.unique_users, r.n_nodes, r.n_edges, r.n_components, r.reciprocity) == ("a", 40, 36, 4, 4, 4, 1, 0)
    assert r.edges_per_tweet == pytest.approx(4 / 36) and len(prototype.FEATURES) == 17


def test_early_features_join_once(spark):
    # each join and each window of a topic adds its sort to the memory of the one task that has the topic
    posts = spark.createDataFrame([(1, "t", 0, 1, "a", ["b"])], "event_id long, topic string, label int, ts long, author string, targets array<string>")
    plan = prototype.early_features(posts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Window [") == 1
