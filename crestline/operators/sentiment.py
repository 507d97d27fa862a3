"""Sentiment of texts: a pluggable scorer, a score cache by text key, and aggregates by topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.cleaning import ratio, stripped, text_key

STRONG = 0.6
Scorer = Callable[[DataFrame], DataFrame]


def hash_scorer(texts: DataFrame) -> DataFrame:
    """key, p_neg, p_neu, p_pos from the key's own digits: a stand-in that any engine can reproduce.

    A model takes its place as a function from a table with key and text to the same columns, for example by
    ``mapInPandas`` over batches sorted by length.
    """
    part = lambda at: F.conv(F.substring("key", at, 4), 16, 10).cast("double") + 1
    weights = texts.select("key", part(1).alias("a"), part(5).alias("b"), part(9).alias("c"))
    total = F.col("a") + F.col("b") + F.col("c")
    return weights.select("key", (F.col("a") / total).alias("p_neg"), (F.col("b") / total).alias("p_neu"), (F.col("c") / total).alias("p_pos"))


def batched_scorer(score: Callable[[list[str]], list[tuple[float, float, float]]], batch: int = 16) -> Scorer:
    """A scorer from a function on lists of texts; batches hold texts of similar length."""

    def run(texts: DataFrame) -> DataFrame:
        import pandas as pd

        def scored(frames):
            for pdf in frames:
                rows = [p for i in range(0, len(pdf), batch) for p in score(pdf["text"].iloc[i : i + batch].tolist())]
                yield pd.DataFrame({"key": pdf["key"], "p_neg": [p[0] for p in rows], "p_neu": [p[1] for p in rows], "p_pos": [p[2] for p in rows]})

        return texts.sortWithinPartitions(F.length("text")).select("key", "text").mapInPandas(scored, "key string, p_neg double, p_neu double, p_pos double")

    return run


def topic_texts(texts: DataFrame) -> DataFrame:
    """topic and key of texts that are not blank."""
    return texts.filter(F.col("text").isNotNull() & (stripped(F.col("text")) != "")).select("topic", text_key(F.col("text")).alias("key"), "text")


def score_cache(keyed: DataFrame, cache: DataFrame | None, scorer: Scorer = hash_scorer) -> DataFrame:
    """The cache with the scores of keys that it lacks; each distinct text is scored once."""
    fresh = keyed.groupBy("key").agg(F.min("text").alias("text"))
    if cache is None:
        return scorer(fresh)
    return cache.unionByName(scorer(fresh.join(cache.select("key"), "key", "left_anti")))


def sentiment_features(keyed: DataFrame, cache: DataFrame, strong: float = STRONG) -> DataFrame:
    """Means, spread, strength and class shares of each topic's polarity."""
    polarity = F.col("p_pos") - F.col("p_neg")
    kind: Column = F.when((F.col("p_neg") >= F.col("p_neu")) & (F.col("p_neg") >= F.col("p_pos")), 0).when(F.col("p_neu") >= F.col("p_pos"), 1).otherwise(2)
    rows = keyed.join(cache, "key").select("topic", polarity.alias("v"), (1 - F.col("p_neu")).alias("strength"), kind.alias("kind"))
    n = F.count(F.lit(1))
    share = lambda k: ratio(F.count_if(F.col("kind") == k), n)
    scored = rows.groupBy("topic").agg(
        F.avg("v").alias("sent_mean"),
        F.var_pop("v").alias("sent_var"),
        F.avg("strength").alias("sent_intensity"),
        ratio(F.count_if(F.abs("v") >= strong), n).alias("sent_strong_frac"),
        share(2).alias("sent_pos_frac"),
        share(0).alias("sent_neg_frac"),
        share(1).alias("sent_neu_frac"),
        F.when(F.stddev_pop("v") > 1e-9, F.skewness("v")).otherwise(0.0).alias("sent_skew"),
        n.alias("meta_sent_n"),
    )
    return scored.withColumn("sent_polarisation", 2 * F.least("sent_pos_frac", "sent_neg_frac"))


def completed_sentiment(scored: DataFrame, topics: DataFrame) -> DataFrame:
    """Every topic of ``topics``; one without scored texts has zeros."""
    return topics.select("topic").join(scored, "topic", "left").fillna(0, [c for c in scored.columns if c != "topic"])


#: Fixed value: what the valences' sum is set against, so that a few words do not reach the ends.
COMPOUND_ALPHA = 15.0


def lexicon_baseline(texts: DataFrame, lexicon: DataFrame, language: str = "en", strong: float = 0.5) -> DataFrame:
    """topic, lex_mean, lex_var, lex_strong_frac, lex_n from rows (topic, lang, text) and a lexicon (word, valence).

    A text's compound score is its valences' sum s over the root of s * s + COMPOUND_ALPHA. Only texts of
    ``language`` are scored; a topic without any has zeros. A word that the lexicon has twice counts with its
    least valence.
    """
    once = lexicon.groupBy(F.lower("word").alias("word")).agg(F.min("valence").cast("double").alias("valence"))
    mine = texts.filter((F.col("lang") == language) & F.col("text").isNotNull() & (stripped(F.col("text")) != "")).select("topic", "text")
    counted = mine.groupBy("topic", F.xxhash64("text").alias("key"), "text").agg(F.count(F.lit(1)).alias("times"))
    words = counted.select("topic", "key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0)).alias("word"))
    sums = words.join(once, "word").groupBy("topic", "key").agg(F.sum("valence").alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    each = counted.select("topic", "key", "times").join(sums, ["topic", "key"], "left").select("topic", "times", (s / F.sqrt(s * s + COMPOUND_ALPHA)).alias("c"))
    n = F.sum("times")
    mean = ratio(F.sum(F.col("times") * F.col("c")), n)
    square = ratio(F.sum(F.col("times") * F.col("c") * F.col("c")), n)
    found = each.groupBy("topic").agg(mean.alias("lex_mean"), F.greatest(square - mean * mean, F.lit(0.0)).alias("lex_var"), ratio(F.sum(F.when(F.abs("c") >= strong, F.col("times")).otherwise(0)), n).alias("lex_strong_frac"), n.alias("lex_n"))
    return completed_sentiment(found, texts.select("topic").distinct())


def lexicon_coverage(texts: DataFrame, language: str = "en") -> DataFrame:
    """How many texts the lexicon can speak of at all: n_texts, n_language, share."""
    n, own = F.count(F.lit(1)), F.count_if(F.col("lang") == language)
    return texts.agg(n.alias("n_texts"), own.alias("n_language"), ratio(own, n).alias("share"))


def lead_bins(kept: DataFrame, leads: tuple[int, ...], window: int) -> DataFrame:
    """topic, bin: the union of the windows before every lead, not below 0."""
    spans = F.array(*[F.struct(F.greatest(F.col("peak_bin") - lead - window, F.lit(0)).alias("a"), (F.col("peak_bin") - lead - 1).alias("b")) for lead in leads])
    filled = F.filter(spans, lambda s: s["b"] >= s["a"])
    return kept.select("topic", F.explode(F.array_distinct(F.flatten(F.transform(filled, lambda s: F.sequence(s["a"], s["b"]))))).alias("bin"))


def texts_in_bins(posts: DataFrame, bins: DataFrame) -> DataFrame:
    """topic, bin, text of posts in a topic's bins; the first of each (event_id, topic), and then no blank ones."""
    first = posts.join(bins, ["topic", "bin"]).groupBy("event_id", "topic").agg(F.min(F.struct("ts", "bin", "text")).alias("p"))
    return first.select("topic", "p.bin", "p.text").filter(F.col("text").isNotNull() & (stripped(F.col("text")) != ""))


def window_language_mix(posts: DataFrame, kept: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """The mix of all languages inside each unit's own window, each (id, topic) once; a unit without posts has zeros."""
    inside = posts.join(kept.select("topic", "window_start_bin", "window_end_bin"), "topic").filter("bin >= window_start_bin AND bin < window_end_bin")
    first = inside.groupBy("event_id", "topic", "label").agg(F.min_by("lang", "ts").alias("lang"))
    mix = language_mix(first, languages)
    return kept.select("topic", "label").join(mix.drop("label"), "topic", "left").fillna(0, [c for c in mix.columns if c not in ("topic", "label")])


def language_mix(posts: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Shares of ``languages`` in each topic's posts, with the total and the number of distinct ones."""
    lang = F.coalesce("lang", F.lit("unk"))
    counts = posts.groupBy("topic", "label").agg(F.count(F.lit(1)).alias("lang_total"), F.countDistinct(lang).alias("lang_n_distinct"), *[F.count_if(lang == x).alias(f"n_{x}") for x in languages])
    share = lambda x: (F.col(f"n_{x}") / F.greatest(F.col("lang_total"), F.lit(1))).alias(f"lang_{x}")
    return counts.select("topic", "label", "lang_total", "lang_n_distinct", *[share(x) for x in languages])


def top_languages(posts: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent languages over all topics; ties in order of their names."""
    return posts.groupBy(F.coalesce("lang", F.lit("unk")).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(n)


def workload(texts: DataFrame) -> DataFrame:
    """How much there is to score: texts, distinct ones, lengths, and tokens at two rates of characters."""
    n = F.length("text")
    keyed = topic_texts(texts)
    return keyed.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.countDistinct("key").alias("n_distinct"),
        *[F.percentile(n, F.lit(q)).alias(f"chars_p{int(100 * q)}") for q in (0.5, 0.9, 0.99)],
        F.max(n).alias("chars_max"),
        F.round(F.avg(n / 4.0), 6).alias("tokens_at_4"),
        F.round(F.avg(n / 3.2), 6).alias("tokens_at_3_2"),
        F.round(ratio(F.count_if(n / 4.0 > 128), F.count(F.lit(1))), 6).alias("over_128"),
    )
