"""The early study's extractor: seventeen features of a topic's first posts, and what it calls a trending name.

Two rules for leaving out trending hashtags can be had: ``exact`` compares a hashtag with its sign as it is
written, ``cleaned`` compares cleaned names. The first misses names that differ in case or ending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.cleaning import clean_topic
from crestline.operators import network, units

FEATURES = ("total_count", "tweet_count", "unique_users", "n_nodes", "n_edges", "density", "edges_per_tweet", "max_in_degree", "mean_in_degree", "max_out_degree", "n_components", "largest_wcc_frac", "mean_component_size", "reciprocity", "pagerank_gini", "max_pagerank", "mean_clustering")
EARLIEST, MIN_POSTS = 150, 30


def left_out(tags: DataFrame, trending: DataFrame, rule: str = "cleaned") -> DataFrame:
    """Rows of ``tags`` (tag) that are not trending (trend) by one of the two rules."""
    if rule not in ("exact", "cleaned"):
        raise ValueError(f"no such rule: {rule}")
    name = F.concat(F.lit("#"), F.lower("tag")) if rule == "exact" else clean_topic(F.col("tag"))
    known = trending.select((F.col("trend") if rule == "exact" else clean_topic(F.col("trend"))).alias("known")).distinct()
    return tags.withColumn("known", name).join(known, "known", "left_anti").drop("known")


def early_features(posts: DataFrame, earliest: int = EARLIEST, min_posts: int = MIN_POSTS) -> DataFrame:
    """topic, label and FEATURES over each topic's ``earliest`` posts; topics with fewer than ``min_posts`` of them go.

    A topic's early posts are few, so they become one row, and their graph is measured from it without further shuffles.
    """
    totals = posts.groupBy("topic", "label").agg(F.count(F.lit(1)).alias("total_count"))
    early = units.topk_earliest(posts, earliest).groupBy("topic").agg(F.collect_list(F.struct("author", "targets")).alias("posts")).filter(F.size("posts") >= min_posts)
    joined = totals.join(network.small_graph_features(early), "topic")
    return joined.select("topic", "label", *[F.col(c).cast("double").alias(c) for c in FEATURES])
