"""The analysis bound to the test tables: events as posts, users as topics, documents as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import config
from crestline.operators import network, sentiment, temporal, units
from crestline.sources.posts import read_events, with_previous
from crestline.sources.sinks import settled

RULES = config.EVENT_RULES
LANG = config.FEATURE_LANGUAGE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.topic_bin_counts(units.dedup_posts(read_events(spark, sf_dir)), RULES.n_bins, LANG)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.dense_series(counts(spark, sf_dir), RULES.n_bins)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.verdicts(series(spark, sf_dir), RULES)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.units(judged(spark, sf_dir), RULES)


def window_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window posts of kept units in the feature language, with targets."""
    return units.window_posts(with_previous(read_events(spark, sf_dir)), kept(spark, sf_dir), LANG)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.windows_of(judged(spark, sf_dir), RULES.lead, RULES.window)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts of their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), "text")


def keyed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.topic_texts(texts(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with two arms: line items by discount and by tax, whether they were returned."""
    arms = F.explode(F.array(F.struct(F.lit("discount").alias("arm"), F.round(F.col("l_discount") * 10, 6).alias("p")), F.struct(F.lit("tax").alias("arm"), F.round(F.col("l_tax") * 12.5, 6).alias("p"))))
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), (F.col("l_returnflag") == "R").cast("int").alias("label"), arms.alias("a"))
    return rows.select("key", "label", "a.arm", "a.p")


def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the text of the document that has their id; most have none."""
    texts_of = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")
    return read_events(spark, sf_dir).join(texts_of, "event_id")


def sentiment_of(spark: SparkSession, sf_dir: str, units_kept: DataFrame, rules: config.Rules = RULES, language: str | None = LANG, scorer: sentiment.Scorer = sentiment.hash_scorer) -> DataFrame:
    """Sentiment of each unit's window in the feature language; a unit without texts has zeros."""
    bins = sentiment.lead_bins(units_kept, (rules.lead,), rules.window)
    posts = post_texts(spark, sf_dir)
    own = posts if language is None else posts.filter(F.col("lang") == language)
    keyed = sentiment.topic_texts(sentiment.texts_in_bins(own, bins))
    return sentiment.completed_sentiment(sentiment.sentiment_features(keyed, sentiment.score_cache(keyed, None, scorer)), units_kept)


def unit_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment_of(spark, sf_dir, kept(spark, sf_dir))


def window_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the five event types in each kept unit's window."""
    return sentiment.window_language_mix(read_events(spark, sf_dir), kept(spark, sf_dir), ("click", "error", "purchase", "signup", "view"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined matrix of what SQL expresses: units, volume, degrees, growth and shape; a unit without posts has zeros."""
    of_units = settled(judged(spark, sf_dir))  # a row for each topic, read by every part
    units_kept = units.units(of_units, RULES)
    posts = settled(units.window_posts(with_previous(read_events(spark, sf_dir)), units_kept, LANG))
    shape = temporal.shape_features(temporal.windows_of(of_units, RULES.lead, RULES.window), RULES.window)
    parts = [network.window_volume(posts), network.degrees(posts), network.growth(posts, units_kept, config.GROWTH_SLICES), shape]
    return settled(units.completed(units_kept.select("topic", "label"), parts).drop("empty"))


def matrix_of(spark: SparkSession, sf_dir: str, rules: config.Rules = RULES, language: str | None = LANG) -> DataFrame:
    """Every feature set by topic, and feature_language_frac; raises ValueError unless columns and sets agree.

    Units, their posts and the matrix are settled: the parts read the first two dozens of times, and the models' plans
    would hold as many copies of how they were made.
    """
    of_units = settled(units.verdicts(series(spark, sf_dir), rules))
    units_kept = units.units(of_units, rules)
    posts = settled(units.window_posts(with_previous(read_events(spark, sf_dir)), units_kept, language))
    spans = temporal.windows_of(of_units, rules.lead, rules.window)
    parts = [
        *(network.window_volume(posts), network.degrees(posts), network.growth(posts, units_kept, config.GROWTH_SLICES), temporal.shape_features(spans, rules.window)),
        *(network.reciprocity(posts), network.clustering(posts), network.whole_graph_features(posts), temporal.arima_features(spans), sentiment_of(spark, sf_dir, units_kept, rules, language)),
    ]
    whole = units.completed(units_kept.select("topic", "label", "feature_language_frac"), parts).drop("empty")
    given = [c for own in config.FEATURE_SETS.values() for c in own]
    columns = ["topic", "label", *[c for c in whole.columns if c in given or c.startswith("meta_")]]
    config.validate(columns)
    return settled(whole.select(*columns, "feature_language_frac"))


def full_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_of(spark, sf_dir).drop("feature_language_frac")


def empty_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, label of kept units whose window has no text."""
    scored = unit_sentiment(spark, sf_dir).filter("meta_sent_n = 0").select("topic")
    return kept(spark, sf_dir).select("topic", "label").join(scored, "topic", "left_semi")


#: Feature columns that the SQL checks cover.
SQL_FEATURES = ["window_tweets", "unique_users", "tweets_per_user", "tweets_per_active_bin", "active_bin_frac", "n_nodes", "n_edges", "density", "edges_per_tweet", *temporal.SHAPE]
