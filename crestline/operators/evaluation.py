"""Metrics and tests on scores and feature tables, as aggregations and cumulative sums.

Scores are rows (arm, label, p) with p from 0 to 1; with a column n, a row counts so many times. Curves need running totals in order of p: rows are first
summed by distinct p, then totals run within ``BUCKETS`` buckets of p and over the buckets, so no task holds
a whole arm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions.cleaning import ratio

BUCKETS = 1024
#: Partitions for the arms of a bootstrap.
BOOT_TASKS = 48


def times(scores: DataFrame) -> Column:
    """How often a row counts."""
    return F.col("n") if "n" in scores.columns else F.lit(1)


def curve(scores: DataFrame) -> DataFrame:
    """arm, p, tp, fp (rows at or above p), pos, neg (at p), n_pos, n_neg."""
    n = times(scores)
    by_p = scores.groupBy("arm", "p").agg(F.sum(F.col("label") * n).alias("pos"), F.sum((1 - F.col("label")) * n).alias("neg")).withColumn("bucket", F.floor(F.col("p") * BUCKETS).cast("int"))
    totals = by_p.groupBy("arm", "bucket").agg(F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"))
    above = Window.partitionBy("arm").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("arm")
    run = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    # at most BUCKETS + 1 rows an arm
    offsets = totals.select("arm", "bucket", run("b_pos").alias("tp_above"), run("b_neg").alias("fp_above"), F.sum("b_pos").over(whole).alias("n_pos"), F.sum("b_neg").over(whole).alias("n_neg"))
    inside = Window.partitionBy("arm", "bucket").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    rows = by_p.withColumn("tp_in", F.sum("pos").over(inside)).withColumn("fp_in", F.sum("neg").over(inside)).join(offsets, ["arm", "bucket"])
    return rows.select("arm", "p", (F.col("tp_above") + F.col("tp_in")).alias("tp"), (F.col("fp_above") + F.col("fp_in")).alias("fp"), "pos", "neg", "n_pos", "n_neg")


def pr_curve(scores: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate at each distinct p."""
    tp, fp = F.col("tp"), F.col("fp")
    return curve(scores).select("arm", "p", ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("n_pos")).alias("recall"), ratio(fp, F.col("n_neg")).alias("fpr"))


def average_precision(scores: DataFrame) -> DataFrame:
    """Steps of recall times precision, equal scores together, and the lift over the share of positives."""
    c = curve(scores)
    ap = F.sum(ratio(F.col("pos"), F.col("n_pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    prevalence = ratio(F.max("n_pos"), F.max("n_pos") + F.max("n_neg"))
    return c.groupBy("arm").agg(ap.alias("pr_auc"), prevalence.alias("prevalence")).withColumn("lift", F.col("pr_auc") - F.col("prevalence"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """Share of pairs of a positive and a negative in the right order, ties as one half."""
    c = curve(scores)
    return c.groupBy("arm").agg((F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.max(F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"))


def threshold_metrics(scores: DataFrame, cut: float = 0.5) -> DataFrame:
    """Confusion counts and F1, precision and recall at a cut; 0 where nothing can be divided."""
    hit, true = F.col("p") >= cut, F.col("label") == 1
    count = lambda those: F.sum(F.when(those, times(scores)).otherwise(0)).cast("long")
    c = scores.groupBy("arm").agg(count(hit & true).alias("tp"), count(hit & ~true).alias("fp"), count(~hit & true).alias("fn"), count(~hit & ~true).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def binomial_tail(low: Column, n: Column) -> Column:
    """P(X <= low) for n fair coins, by running logarithms of binomial coefficients."""
    start = F.struct(F.lit(0.0).alias("log_c"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        log_c = acc["log_c"] + F.log((n - k + 1).cast("double")) - F.log(k.cast("double"))
        return F.struct(log_c.alias("log_c"), (acc["total"] + F.exp(log_c - n * F.log(F.lit(2.0)))).alias("total"))

    return F.aggregate(F.when(low >= 1, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<long>")), start, step, lambda acc: acc["total"])


def mcnemar(pairs: DataFrame, cut: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Discordant counts and the exact p-value from rows (label, p_a, p_b), for each value of ``by``."""
    right = lambda c: (F.col(c) >= cut).cast("int") == F.col("label")
    n = pairs.groupBy(*by).agg(F.count_if(right("p_a") & ~right("p_b")).alias("n10"), F.count_if(~right("p_a") & right("p_b")).alias("n01"))
    total = F.col("n10") + F.col("n01")
    return n.select(*by, "n10", "n01", F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.least("n10", "n01"), total))).alias("p_value"))


def bootstrap_ci(scores: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile intervals of average precision over resamples of each arm's rows, an arm in one task.

    Rows are put in order of p once: a resample then only counts how often each distinct p is drawn.
    """

    def of_arm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "p", "label"])
        y, p, rng = pdf["label"].to_numpy(), pdf["p"].to_numpy(), np.random.default_rng(seed)
        distinct, place = np.unique(-p, return_inverse=True)
        code, got = 2 * place + (y == 1), []
        for _ in range(resamples):
            drawn = np.bincount(code[rng.integers(0, len(y), len(y))], minlength=2 * len(distinct)).reshape(-1, 2)
            pos, n = drawn[:, 1], drawn.sum(1)
            if 0 < pos.sum() < len(y):
                got.append(float((pos / pos.sum() * np.cumsum(pos) / np.maximum(np.cumsum(n), 1)).sum()))
        low, high = np.percentile(got, [2.5, 97.5]) if got else (np.nan, np.nan)
        return pd.DataFrame([(pdf["arm"].iloc[0], ap_of(y, p), low, high, len(got))], columns=["arm", "pr_auc", "low", "high", "n_used"])

    # a number of partitions is asked for, or small arms would be put together in one task
    dealt = scores.select("arm", "key", "label", "p").repartition(BOOT_TASKS, "arm")
    return dealt.groupBy("arm").applyInPandas(of_arm, "arm string, pr_auc double, low double, high double, n_used long")


def ap_of(y: np.ndarray, p: np.ndarray) -> float:
    """Average precision with equal scores together."""
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    last = np.append(np.flatnonzero(np.diff(p)), len(p) - 1)
    tp = np.cumsum(y)[last]
    return float((np.diff(np.append(0, tp)) / max(1, y.sum()) * tp / (last + 1)).sum())


def stacked(features: DataFrame, columns: list[str], keys: tuple[str, ...] = ("topic", "label")) -> DataFrame:
    """One row for each feature and row: keys, feature, value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    return features.select(*keys, pairs.alias("e")).select(*keys, "e.feature", "e.value")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    ordered = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def univariate_auc(long: DataFrame) -> DataFrame:
    """For each feature, how well it alone orders the labels, in either direction; one half if constant."""
    ranked = long.withColumn("r", average_rank("value", ["feature"]))
    sums = ranked.groupBy("feature").agg(F.sum(F.col("label").cast("long")).alias("np"), F.sum((1 - F.col("label")).cast("long")).alias("nn"), F.sum(F.col("r") * F.col("label")).alias("rp"))
    auc = ratio(F.col("rp") - F.col("np") * (F.col("np") + 1) / 2.0, F.col("np") * F.col("nn"))
    auc = F.when((F.col("np") > 0) & (F.col("nn") > 0), auc).otherwise(0.5)
    return sums.select("feature", F.greatest(auc, 1 - auc).alias("auc"))


def size_audit(features: DataFrame, columns: list[str], proxy: str, cut: float = 0.4) -> DataFrame:
    """Spearman correlation of each feature with the volume proxy, flagged from ``cut`` on; 0 if either is constant."""
    long = stacked(features, columns, ("topic", proxy)).withColumnRenamed(proxy, "size")
    ranked = long.withColumn("rv", average_rank("value", ["feature"])).withColumn("rs", average_rank("size", ["feature"]))
    varied = ranked.groupBy("feature").agg(F.avg("rv").alias("mv"), F.avg("rs").alias("ms"))
    back = ranked.join(F.broadcast(varied), "feature") if len(columns) <= 1000 else ranked.join(varied, "feature")
    dv, ds = F.col("rv") - F.col("mv"), F.col("rs") - F.col("ms")
    rho = back.groupBy("feature").agg(F.sum(dv * ds).alias("c"), F.sum(dv * dv).alias("v"), F.sum(ds * ds).alias("s"))
    value = ratio(F.col("c"), F.sqrt(F.col("v") * F.col("s")))
    return rho.select("feature", value.alias("rho"), (F.abs(value) >= cut).alias("flagged")).orderBy(F.desc(F.abs("rho")), "feature")


def audit_differences(audit: DataFrame, size_free: tuple[str, ...]) -> list[str]:
    """Features that the audit flags although the settings call them size-free; the settings are at fault for each."""
    flagged = {r["feature"] for r in audit.filter("flagged").select("feature").collect()}  # one row a feature
    return sorted(flagged & set(size_free))


def class_summary(long: DataFrame) -> DataFrame:
    """Means by class and the share of zeros of each feature."""
    return long.groupBy("feature").agg(F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("mean_pos"), F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("mean_neg"), ratio(F.count_if(F.col("value") == 0), F.count(F.lit(1))).alias("zero_frac"))


def fold_assignment(rows: DataFrame, key: str, folds: int = 5, seed: str | Column = "42", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``fold``: rows of each label (and of each value of ``by``) dealt out in order of a hash of their key.

    The hash's first digits make buckets; places within a bucket follow those of all buckets before it, so no
    task sorts all rows of a label.
    """
    groups = [*by, "label"]
    hashed = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.lit(seed) if isinstance(seed, str) else seed))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = hashed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 256 rows a group
    before = sizes.select(*groups, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", key)))
    placed = inside.join(before, [*groups, "_b"])
    return placed.select(*rows.columns, ((F.col("_before") + F.col("_r") - 1) % folds).cast("int").alias("fold"))


def residualise(rows: DataFrame, columns: list[str], proxy: str) -> DataFrame:
    """For each fold, features minus their line on the proxy fitted on the other folds: topic, fold, feature, residual.

    Sums by fold are taken once; those of all other folds are the total minus the fold's own.
    """
    long = stacked(rows, columns, ("topic", "fold", proxy)).withColumnRenamed(proxy, "x")
    parts = long.groupBy("feature", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("value").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("value")).alias("sxy"))
    every = Window.partitionBy("feature")
    others = parts.select("feature", "fold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    lines = others.select("feature", "fold", slope.alias("slope"), ratio(F.col("sy") - slope * F.col("sx"), F.col("n")).alias("base"))
    return long.join(lines, ["feature", "fold"]).select("topic", "fold", "feature", (F.col("value") - F.col("base") - F.col("slope") * F.col("x")).alias("residual"))


def quantiles_by_class(long: DataFrame, points: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return long.groupBy("feature", "label").agg(*[F.percentile("value", F.lit(q)).alias(f"p{int(100 * q)}") for q in points])


def share_histogram(rows: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Counts by label in equal bins from 0 to 1; the last includes 1."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col(value).between(0, 1)).groupBy("label", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the normal distribution (Abramowitz and Stegun, 7.1.26)."""
    x = F.abs(z) / float(np.sqrt(2))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return tail * F.exp(-x * x)


def mann_whitney(long: DataFrame) -> DataFrame:
    """U of the positives, z with tie and continuity correction, and the two-sided p for each feature."""
    ranked = long.withColumn("r", average_rank("value", ["feature"]))
    sums = ranked.groupBy("feature").agg(F.sum(F.col("label").cast("long")).alias("n1"), F.sum((1 - F.col("label")).cast("long")).alias("n2"), F.sum(F.col("r") * F.col("label")).alias("r1"))
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).cast("double").alias("t"))
    ties = counts.groupBy("feature").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1))))
    z = ratio(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), spread)
    return sums.join(ties, "feature").select("feature", u.alias("u"), z.alias("z"), normal_two_sided(z).alias("p_value"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank statistic of rows (test, a, b), zero differences left out, by the normal approximation."""
    d = pairs.select("test", F.round(F.col("a") - F.col("b"), 10).alias("d")).filter("d <> 0").withColumn("size", F.abs("d"))
    ranked = d.withColumn("r", average_rank("size", ["test"]))
    sums = ranked.groupBy("test").agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n"))
    counts = d.groupBy("test", "size").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy("test").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = ratio(F.least("w_plus", "w_minus") - n * (n + 1) / 4, spread)
    return sums.join(counts, "test").select("test", "n", "w_plus", "w_minus", z.alias("z"), normal_two_sided(z).alias("p_value"))
