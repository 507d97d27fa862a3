"""From posts to units: de-duplication, dense series, peaks, verdicts and pre-peak windows.

A topic's series is one row with arrays of ``n_bins`` counts, so everything after the two aggregations is
expressions within a row, without windows or further shuffles. Sums of counts stay whole numbers; the
smoothed curve is kept as sums, so equal heights are equal and the earliest peak is the earliest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.config import Rules, Sweep
from crestline.functions.cleaning import ratio

REASONS = ("too_small", "left_censored", "right_censored_no_tail", "right_censored_no_decay", "window_before_band_start", "window_too_sparse")


def dedup_posts(posts: DataFrame) -> DataFrame:
    """The first post of each (event_id, topic) in order of time; aggregated before it is shuffled."""
    rest = [c for c in posts.columns if c not in ("event_id", "topic", "ts")]
    first = posts.groupBy("event_id", "topic").agg(F.min(F.struct("ts", *rest)).alias("first"))
    return first.select("event_id", "topic", F.col("first.ts").alias("ts"), *[F.col(f"first.{c}").alias(c) for c in rest])


def topic_bin_counts(posts: DataFrame, n_bins: int, language: str) -> DataFrame:
    """topic, label, bin, n_all, n_feat of posts on the grid."""
    return posts.filter(F.col("bin").between(0, n_bins - 1)).groupBy("topic", "label", "bin").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("lang") == language).alias("n_feat"))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, one for each (topic, label), behind an aggregation that needs no further shuffle.

    The optimizer would otherwise copy the expressions of a column into each of its uses, and those into
    theirs, when it merges projections and pushes filters down; it does neither through an aggregation.
    """
    return rows.groupBy("topic", "label").agg(*[F.first(c).alias(c) for c in rows.columns if c not in ("topic", "label")])


def dense_series(counts: DataFrame, n_bins: int) -> DataFrame:
    """topic, label, x (counts by bin), f (in the feature language), total; bins without posts have 0."""
    entry = lambda field: F.map_from_entries(F.collect_list(F.struct("bin", field))).alias(field)
    # the maps are columns of an aggregation, so each is built once and not once for every bin
    known = counts.groupBy("topic", "label").agg(entry("n_all"), entry("n_feat"), F.sum("n_all").alias("total"))
    dense = lambda field: F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.try_element_at(F.col(field), b), F.lit(0).cast("long")))
    return settled(settled(known).select("topic", "label", dense("n_all").alias("x"), dense("n_feat").alias("f"), "total"))


def smoothed(x: Column, k: int, n_bins: int) -> Column:
    """Sums over a centred window of ``k`` bins (odd, or the next odd number) with the edges repeated."""
    if k <= 1:
        return x
    half = k // 2
    clamp = lambda b: F.greatest(F.least(b, F.lit(n_bins - 1)), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: sum((F.get(x, clamp(b + d)) for d in range(-half, half + 1)), F.lit(0).cast("long")))


def smooth_width(k: int) -> int:
    return 1 if k <= 1 else k + 1 - k % 2


def slice_sum(x: Column, begin: Column, end: Column) -> Column:
    """The sum of x[begin:end]."""
    return F.aggregate(F.slice(x, begin + 1, F.greatest(end - begin, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)


def with_peaks(series: DataFrame, rules: Rules) -> DataFrame:
    """Adds s (smoothed sums), peak_bin (the earliest highest) and peak (its sum)."""
    s = settled(series.withColumn("s", smoothed(F.col("x"), rules.smooth, rules.n_bins)))
    return settled(s.withColumn("peak", F.array_max("s")).withColumn("peak_bin", (F.array_position("s", F.array_max("s")) - 1).cast("int")))


def verdict(rules: Rules, use_language: bool = True, min_topic: Column | None = None, lead: Column | None = None, window: Column | None = None) -> Column:
    """The first rule that a topic fails, or 'kept'; sides are compared as whole numbers."""
    min_topic, lead, window = (F.lit(default) if c is None else c for c, default in ((min_topic, rules.min_topic), (lead, rules.lead), (window, rules.window)))
    peak, at = F.col("peak"), F.col("peak_bin")
    end = at - lead
    counts = F.col("f" if use_language else "x")
    tail = slice_sum(F.col("s"), at + 1, at + 1 + rules.tail)
    return (
        F.when(F.col("total") < min_topic, "too_small")
        .when((peak > 0) & (100 * F.get("s", F.lit(0)) >= rules.left_percent * peak), "left_censored")
        .when(at > rules.n_bins - 1 - rules.tail, "right_censored_no_tail")
        .when((peak > 0) & (100 * tail >= rules.decay_percent * rules.tail * peak), "right_censored_no_decay")
        .when(end - window < 0, "window_before_band_start")
        .when(slice_sum(counts, end - window, end) < rules.min_window, "window_too_sparse")
        .otherwise("kept")
    )


def verdicts(series: DataFrame, rules: Rules) -> DataFrame:
    """Series with peaks and ``reason``."""
    return settled(with_peaks(series, rules).withColumn("reason", verdict(rules)))


def units(judged: DataFrame, rules: Rules) -> DataFrame:
    """Kept topics with their windows [window_start_bin, window_end_bin)."""
    end = F.col("peak_bin") - rules.lead
    begin = end - rules.window
    n_feat, n_all = slice_sum(F.col("f"), begin, end), slice_sum(F.col("x"), begin, end)
    return judged.filter(F.col("reason") == "kept").select(
        "topic",
        "label",
        F.col("total").alias("total_band_tweets"),
        "peak_bin",
        F.bround(F.col("peak") / smooth_width(rules.smooth), 3).alias("peak_height_smoothed"),
        begin.alias("window_start_bin"),
        end.alias("window_end_bin"),
        n_feat.alias("n_window_tweets"),
        n_all.alias("n_window_tweets_all_langs"),
        F.bround(ratio(n_feat, n_all), 4).alias("feature_language_frac"),
    )


def attrition(judged: DataFrame) -> DataFrame:
    """label, step, reason, dropped and remaining, in the order of the rules; rules that drop none have 0."""
    spark = judged.sparkSession
    steps = spark.createDataFrame(list(enumerate(REASONS)), "step int, reason string")
    totals = judged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    gone = lambda: sum((F.when(F.col("step") >= i, F.col(r)).otherwise(0) for i, r in enumerate(REASONS)), F.lit(0))
    own = F.coalesce(*[F.when(F.col("reason") == r, F.col(r)) for r in REASONS])
    # two labels by six rules
    return totals.join(F.broadcast(steps)).select("label", "step", "reason", own.alias("dropped"), (F.col("n") - gone()).alias("remaining"))


def rates(counts: DataFrame) -> DataFrame:
    """tp, fp, fn, tn to accuracy, recall, precision and error rates; null where nothing can be divided."""
    part = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        (tp + fp + fn + tn).alias("n_scored"),
        part(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        part(tp, tp + fn).alias("recall_of_censored"),
        part(tp, tp + fp).alias("precision_of_flag"),
        part(fn, tp + fn).alias("false_negative_rate"),
        part(fp, fp + tn).alias("false_positive_rate"),
    )


def censor_validation(full: DataFrame, judged: DataFrame, rules: Rules, full_bins: int, band_offset: int) -> DataFrame:
    """How well 'left_censored' tells topics whose true peak lies before the band.

    ``full`` has dense series on the longer grid; only trending topics that are large enough are scored.
    """
    curve = smoothed(F.col("x"), rules.smooth, full_bins)
    true_peak = F.array_position(curve, F.array_max(curve)) - 1
    early = ratio(slice_sum(F.col("x"), F.lit(0), F.lit(band_offset)), F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b))
    truth = full.select("topic", (true_peak < band_offset).alias("censored"), early.alias("early"))
    both = judged.filter((F.col("label") == 1) & (F.col("total") >= rules.min_topic)).select("topic", (F.col("reason") == "left_censored").alias("flagged")).join(truth, "topic")
    counts = both.agg(
        *[F.count_if((F.col("flagged") == f) & (F.col("censored") == c)).alias(name) for name, f, c in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))],
        F.round(F.avg(F.when(F.col("flagged"), F.col("early"))), 4).alias("early_share_flagged"),
        F.round(F.avg(F.when(~F.col("flagged"), F.col("early"))), 4).alias("early_share_kept"),
    )
    return rates(counts)


def unit_sweep(peaked: DataFrame, rules: Rules, sweep: Sweep) -> DataFrame:
    """Units kept under each setting of a grid, with and without the language filter.

    The grid is an array in every row, so topics are not shuffled for each setting: one aggregation counts all.
    """
    grid = [(m, lead, w) for m in sweep.min_topics for lead in sweep.leads for w in sweep.windows]
    settings = F.array(*[F.struct(F.lit(m).alias("min_topic"), F.lit(lead).alias("lead"), F.lit(w).alias("window")) for m, lead, w in grid])
    rows = peaked.withColumn("setting", F.explode(settings)).select("*", "setting.*")
    params = {c: F.col(c) for c in ("min_topic", "lead", "window")}
    end = F.col("peak_bin") - F.col("lead")
    share = ratio(slice_sum(F.col("f"), end - F.col("window"), end), slice_sum(F.col("x"), end - F.col("window"), end))
    kept = rows.withColumn("kept", verdict(rules, True, **params) == "kept").withColumn("kept_all", verdict(rules, False, **params) == "kept")
    kept = kept.withColumn("majority", F.when(F.col("kept"), F.bround(share, 4) >= sweep.majority).otherwise(False))
    count = lambda flag, label: F.count_if(F.col(flag) & (F.col("label") == label))
    return kept.groupBy("min_topic", "lead", "window").agg(
        count("kept", 1).alias("pos"),
        count("kept", 0).alias("neg"),
        count("kept_all", 1).alias("pos_all"),
        count("kept_all", 0).alias("neg_all"),
        (count("kept_all", 1) - count("kept", 1)).alias("lost"),
        count("majority", 1).alias("majority_pos"),
        count("majority", 0).alias("majority_neg"),
    )


def without_trending(tags: DataFrame, trending: DataFrame) -> DataFrame:
    """Rows of the other pool whose topic is not a trending name: the leak guard."""
    return tags.join(trending.select("topic").distinct(), "topic", "left_anti")


def excluded_topics(tags: DataFrame, trending: DataFrame) -> DataFrame:
    return tags.join(trending.select("topic").distinct(), "topic", "left_semi").agg(F.countDistinct("topic").alias("n_excluded"))


def window_posts(posts: DataFrame, kept: DataFrame, language: str | None) -> DataFrame:
    """Posts inside their unit's window; the language goes first, duplicates after the window."""
    rows = posts if language is None else posts.filter(F.col("lang") == language)
    inside = rows.join(kept.select("topic", "window_start_bin", "window_end_bin"), "topic").filter("bin >= window_start_bin AND bin < window_end_bin")
    return dedup_posts(inside)


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each ``key``: the first in ``order``."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(key, *[F.col(f"first.{c}").alias(c) for c in rest]).select(*rows.columns)


def matched(rows: DataFrame, wanted: DataFrame, key: str = "topic") -> DataFrame:
    """The rows whose key is ``wanted``; raises ValueError if some wanted key has no row."""
    lost = [r[key] for r in wanted.select(key).join(rows.select(key), key, "left_anti").limit(10).collect()]
    if lost:
        raise ValueError(f"no rows for {lost}")
    return rows.join(wanted.select(key), key, "left_semi")


def completed(kept: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``kept`` with the columns of ``parts`` by topic; a unit that a part lacks has zeros there and is reported in ``empty``."""
    out = kept.withColumn("empty", F.lit(False))
    for part in parts:
        columns = [c for c in part.columns if c != "topic"]
        out = out.join(part.withColumn("_has", F.lit(True)), "topic", "left").withColumn("empty", F.col("empty") | F.col("_has").isNull())
        out = out.drop("_has").fillna(0, columns)
    return out


def nested_topics(peaked: DataFrame, rules: Rules, leads: tuple[int, ...]) -> DataFrame:
    """Topics that are kept at every lead."""
    all_kept = None
    for lead in leads:
        own = verdict(rules, lead=F.lit(lead)) == "kept"
        all_kept = own if all_kept is None else all_kept & own
    return peaked.filter(all_kept).select("topic", "label")


def topk_earliest(posts: DataFrame, k: int = 150) -> DataFrame:
    """The first ``k`` posts of each topic, by time and id."""
    from pyspark.sql import Window

    by_time = Window.partitionBy("topic").orderBy("ts", "event_id")
    return posts.withColumn("rank", F.row_number().over(by_time)).filter(F.col("rank") <= k)


def rank_pick(rows: DataFrame, key: str, size: str, picks: int) -> DataFrame:
    """``picks`` rows evenly spaced by rank of ``size`` within each label."""
    from pyspark.sql import Window

    by_size = Window.partitionBy("label").orderBy(F.col(size).desc(), key)
    ranked = rows.withColumn("rank", F.row_number().over(by_size) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    taken = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(1, picks - 1)).cast("int"))
    return ranked.filter(F.array_contains(taken, F.col("rank")) | (F.col("n") <= picks)).select("label", key, size, "rank")
