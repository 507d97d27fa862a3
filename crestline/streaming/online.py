"""The grid of counts kept up to date on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline import config


def streaming_counts(events: DataFrame, late: str = "10 minutes", width_seconds: int = config.EVENTS_BIN_SECONDS) -> DataFrame:
    """topic, window, n_all, n_feat by tumbling windows; an event that repeats within the delay counts once."""
    posts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id", "user_id"])
    grouped = posts.groupBy(F.col("user_id").cast("string").alias("topic"), F.window("ts", f"{width_seconds} seconds"))
    return grouped.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("event_type") == config.FEATURE_LANGUAGE).alias("n_feat"))
