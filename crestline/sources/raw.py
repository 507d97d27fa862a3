"""Posts of the two raw pools: one names its topic, the other has hashtags that become topics.

Rows come from ``posts.read_pool``, all strings. A post is event_id, topic, label, bin, lang, author, targets,
ts (its second of the day) and text; a clock outside the band has a null bin. Rows without a topic or an id
go. An author is trimmed and lower-cased, and a blank one or a null is null: such a post counts and has no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.config import Band
from crestline.functions.cleaning import bin_of, clean_topic, parse_screen_names, parse_tags, stripped, time_to_seconds
from crestline.operators import units

COLUMNS = ("id", "date", "time", "language", "username", "mentions", "reply_to", "tweet")


def normal_author(c: Column) -> Column:
    """Trimmed and lower-cased; null if nothing is left."""
    name = F.lower(stripped(c))
    return F.when(name != "", name)


def _posts(pool: DataFrame, topic: Column, label: int, band: Band) -> DataFrame:
    author = normal_author(F.col("username"))
    named = F.array_distinct(F.concat(parse_screen_names(F.col("mentions")), parse_screen_names(F.col("reply_to"))))
    rows = pool.select(
        F.col("id").cast("long").alias("event_id"),
        topic.alias("topic"),
        F.lit(label).alias("label"),
        bin_of(F.col("date"), F.col("time"), band).alias("bin"),
        F.col("language").alias("lang"),
        author.alias("author"),
        named.alias("named"),
        time_to_seconds(F.col("time")).cast("long").alias("ts"),
        F.col("tweet").alias("text"),
    ).filter("event_id IS NOT NULL AND topic <> ''")
    return rows.withColumn("targets", F.filter("named", lambda t: ~t.eqNullSafe(F.col("author")))).drop("named")


def trending_posts(pool: DataFrame, band: Band) -> DataFrame:
    """Posts of the pool that has a column ``trend``."""
    return _posts(pool, clean_topic(F.col("trend")), 1, band)


def tagged_posts(pool: DataFrame, band: Band) -> DataFrame:
    """A post for each distinct hashtag of a row of the pool that has a column ``hashtags``."""
    return _posts(pool, F.explode(F.array_distinct(parse_tags(F.col("hashtags")))), 0, band)


def both_pools(trending: DataFrame, tagged: DataFrame) -> DataFrame:
    """All posts; hashtags that are trending topics are left out of the second pool."""
    return trending.unionByName(units.without_trending(tagged, trending.select("topic")))


def corpus_series(trending: DataFrame, tagged: DataFrame, band: Band, language: str) -> DataFrame:
    """Dense series of both pools' topics on the band's grid, each (id, topic) counted once."""
    first = units.dedup_posts(both_pools(trending, tagged))
    return units.dense_series(units.topic_bin_counts(first, band.n_bins, language), band.n_bins)
