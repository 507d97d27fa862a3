"""Cleaning and parsing functions on hand-made cells."""

import pytest
from pyspark.sql import functions as F

from crestline.config import Band
from crestline.functions import cleaning as c
from crestline.sources.posts import read_pool

BAND = Band("2020-02-25", drop_dates=("2020-02-26",))


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), [("Harbour.csv", "harbour"), ("#RainAtNoon", "rainatnoon"), ("#Lantern.csv", "lantern"), ("Kiln", "kiln"), (" #TwoWords.CSV ", "twowords"), (None, ""), (" ##x", "x")])
def test_clean_topic(spark, raw, want):
    assert one(spark, raw, c.clean_topic) == want and one(spark, want, c.clean_topic) == want


@pytest.mark.parametrize(("cell", "want"), [("['willow', 'OakLeaf']", ["willow", "oakleaf"]), ("", []), ("[]", []), ("nan", []), (None, []), ("plain words", []), ("{'k': 2}", []), ("[1, 'b', '', '#']", ["1", "b"]), ("[\"O'Brien\", 'x']", ["o'brien", "x"])])
def test_parse_tags(spark, cell, want):
    assert one(spark, cell, c.parse_tags) == want


@pytest.mark.parametrize(("cell", "want"), [("[{'screen_name': 'MiraQ', 'name': \"O'x\", 'id': None}, {'screen_name': ' TomasW ', 'ok': True}]", ["miraq", "tomasw"]), ("[{'name': 'x'}]", []), ("[]", []), ("[", []), (None, [])])
def test_parse_screen_names(spark, cell, want):
    assert one(spark, cell, c.parse_screen_names) == want


def test_python_literals_that_json_refuses(spark):
    cell = r"['a' 'b', 'c']"
    assert one(spark, cell, lambda v: c.parse_tags(v, fallback=True)) == ["ab", "c"]


@pytest.mark.parametrize(("clock", "want"), [("17:45:10", 63910), ("1.5", None), ("", None), (None, None), ("8:01:02", None), ("23:15", None), ("99:99:99", 99 * 3600 + 99 * 60 + 99)])
def test_time_to_seconds(spark, clock, want):
    assert one(spark, clock, c.time_to_seconds) == want


@pytest.mark.parametrize(("date", "clock", "want"), [("2020-02-25", "16:00:00", 0), ("2020-02-25", "23:59:59", 95), ("2020-02-25", "15:59:59", None), ("2020-02-26", "16:00:00", None), (None, "16:00:00", None)])
def test_band(spark, date, clock, want):
    r = spark.createDataFrame([(date, clock)], "d string, t string").select(c.bin_of(F.col("d"), F.col("t"), BAND).alias("b")).withColumn("c", c.bin_to_clock(F.col("b"), BAND)).first()
    assert r.b == want and r.c == (BAND.clock_of(want) if want is not None else None)


def test_band_lengths():
    assert (BAND.n_bins, BAND.minutes_to_bins(60), BAND.minutes_to_bins(90), BAND.clock_of(0), BAND.other_hours(1, 23).n_bins) == (96, 12, 18, "16:00", 276)


def test_pool_reading_drops_long_lines_and_fills_short_ones(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,trend,tweet,last\n1,a,"x ""y"", z\nnext",q\n2,b\n3,c,d,e,f\n4,g,h,i\n')
    got = [tuple(r) for r in read_pool(spark, str(tmp_path / "p.csv"), ["id", "trend", "tweet", "last"], ["trend", "id", "tweet"]).collect()]
    assert got == [("a", "1", 'x "y", z\nnext'), ("b", "2", None), ("g", "4", "h")]
