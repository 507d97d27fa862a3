"""Where posts come from: raw CSV pools, and the binding of the ``events`` table to posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline import config
from crestline.functions.cleaning import bin_of_timestamp


def read_pool(spark: SparkSession, path: str, header: Sequence[str], columns: Sequence[str], multiline: bool = True) -> DataFrame:
    """Columns of a raw CSV pool by name, all strings.

    Lines with too many fields are dropped; those with too few have nulls at the end. ``header`` is the
    file's whole header, in order. A file whose cells hold line feeds is read by one task; where none do,
    ``multiline`` can be false, and a file is split over tasks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header] + [T.StructField("_broken", T.StringType())])
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=multiline, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", enforceSchema=True)
    # both kinds of broken line are reported; a short one leaves its last column null
    too_long = F.col("_broken").isNotNull() & F.col(f"`{header[-1]}`").isNotNull()
    return raw.filter(~too_long).select([F.col(f"`{c}`") for c in columns])


def posts_from_events(events: DataFrame) -> DataFrame:
    """event_id, topic, label, bin, lang, author, previous (the topic's author before), ts."""
    author = F.get_json_object("props", "$.k")
    rows = events.select(
        "event_id",
        F.col("user_id").cast("string").alias("topic"),
        (F.col("user_id") % config.TRENDING_EVERY == 0).cast("int").alias("label"),
        bin_of_timestamp(F.col("ts"), config.EVENTS_START, config.EVENTS_BIN_SECONDS).alias("bin"),
        F.col("event_type").alias("lang"),
        author.alias("author"),
        "ts",
    )
    return rows


def with_previous(posts: DataFrame) -> DataFrame:
    """Adds ``targets``: the author of the topic's post before, unless it is the post's own."""
    before = F.lag("author").over(Window.partitionBy("topic").orderBy("ts", "event_id"))
    return posts.withColumn("before", before).withColumn("targets", F.filter(F.array("before"), lambda t: t.isNotNull() & (t != F.col("author")))).drop("before")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
