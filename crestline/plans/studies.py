"""Studies over settings: lead times, language controls, robustness and repeated checks of the classifiers.

Each study builds its matrices by the one builder ``matrix`` and scores them by the one evaluator ``evaluate``,
so settings differ in nothing but their rules.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import config
from crestline.config import Arm, Rules
from crestline.functions.cleaning import ratio
from crestline.operators import evaluation, models, network, sentiment, temporal, units
from crestline.plans import bindings as b
from crestline.sources.posts import read_events, with_previous
from crestline.sources.sinks import settled

ARMS = tuple(a for a in config.ARMS if a.name in ("volume_only", "volume_plus_structure", "structure_size_free", "full_fusion"))
#: The fewest units, and the fewest of each class, that a setting is scored with.
MIN_UNITS, MIN_CLASS = 40, 12


def matrix(spark: SparkSession, sf_dir: str, rules: Rules = b.RULES, language: str | None = b.LANG) -> DataFrame:
    """All features of the units that ``rules`` keep, a unit without posts or texts with zeros."""
    return b.matrix_of(spark, sf_dir, rules, language)


def large_enough(rows: DataFrame, min_units: int = MIN_UNITS, min_class: int = MIN_CLASS) -> bool:
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    return n["n"] >= min_units and min(n["pos"], n["n"] - n["pos"]) >= min_class


def evaluate(rows: DataFrame, arms: tuple[Arm, ...] = ARMS, seed: str = "42", **settings) -> DataFrame:
    """arm, pr_auc, prevalence, lift, roc_auc of out-of-fold scores."""
    scored = settled(models.oof_scores(rows, arms, seed=seed, **settings).select("arm", "label", "p"))  # read by both scores
    return evaluation.average_precision(scored).join(evaluation.roc_auc(scored), "arm")


def arm_pairs(oof: DataFrame, base: str) -> DataFrame:
    """Each arm's out-of-fold decisions against those of ``base``: arm, n10, n01, p_value."""
    other = oof.filter(F.col("arm") != base).select("arm", "topic", "label", F.col("p").alias("p_a"))
    joined = other.join(oof.filter(F.col("arm") == base).select("topic", F.col("p").alias("p_b")), "topic")
    return evaluation.mcnemar(joined, by=("arm",))


def ablation(rows: DataFrame, arms: tuple[Arm, ...] = config.ARMS, base: str = "volume_extended", **fit) -> DataFrame:
    """The table of arms: scores, interval of average precision, and the test against ``base``."""
    oof = settled(models.oof_scores(rows, arms, **fit))
    scored = oof.select("arm", "label", "p")
    intervals = evaluation.bootstrap_ci(oof.withColumn("key", F.col("topic"))).select("arm", "low", "high")
    table = evaluation.average_precision(scored).join(evaluation.roc_auc(scored), "arm").join(intervals, "arm")
    return table.join(arm_pairs(oof, base), "arm", "left")


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


NONE = "setting string, arm string, pr_auc double, prevalence double, lift double, roc_auc double"


def matrix_once(spark: SparkSession, sf_dir: str, rules: Rules, made: dict[Rules, DataFrame]) -> DataFrame:
    """The matrix of ``rules``, kept for the settings that share them."""
    if rules not in made:
        made[rules] = matrix(spark, sf_dir, rules)
    return made[rules]


def sweep(spark: SparkSession, sf_dir: str, settings: dict[str, Rules], only: DataFrame | None = None, made: dict[Rules, DataFrame] | None = None, **fit) -> DataFrame:
    """Scores of the arms under each setting that has units enough; ``only`` keeps the same topics throughout.

    ``made`` holds matrices by rules, those of this sweep are added.
    """
    parts, made = [], {} if made is None else made
    for name, rules in settings.items():
        among = (lambda rows: rows) if only is None else (lambda rows: rows.join(only.select("topic"), "topic", "left_semi"))
        kept = units.units(units.verdicts(b.series(spark, sf_dir), rules), rules)
        if large_enough(among(kept)):  # before any feature is made
            rows = among(matrix_once(spark, sf_dir, rules, made))
            parts.append(evaluate(rows, **fit).withColumn("setting", F.lit(name)))
    found = _union(parts)
    return spark.createDataFrame([], NONE) if found is None else found.select(*[c.split()[0] for c in NONE.split(", ")])


def lead_time(spark: SparkSession, sf_dir: str, leads: tuple[int, ...] = (4, 7, 14, 21), **fit) -> DataFrame:
    """Scores by lead, over each lead's own units and over those that every lead keeps."""
    settings = {f"lead_{lead}": replace(b.RULES, lead=lead) for lead in leads}
    same = units.nested_topics(units.with_peaks(b.series(spark, sf_dir), b.RULES), b.RULES, leads)
    made: dict[Rules, DataFrame] = {}
    own = sweep(spark, sf_dir, settings, made=made, **fit)
    return own.unionByName(sweep(spark, sf_dir, {f"nested_{k}": r for k, r in settings.items()}, only=same, made=made, **fit))


def robustness(spark: SparkSession, sf_dir: str, **fit) -> DataFrame:
    """Scores with fewer or more posts asked for, other window lengths, and other folds."""
    settings = {f"min_window_{m}": replace(b.RULES, min_window=m) for m in (1, 2, 3)} | {f"window_{w}": replace(b.RULES, window=w) for w in (12, 16, 20)}
    made: dict[Rules, DataFrame] = {}
    found = sweep(spark, sf_dir, settings, made=made, **fit)
    if not large_enough(b.kept(spark, sf_dir)):
        return found
    rows = matrix_once(spark, sf_dir, b.RULES, made)
    dealt = [evaluate(rows, seed=str(42 + offset), **fit).withColumn("setting", F.lit(f"folds_{offset}")) for offset in (3, 4, 5)]
    return reduce(DataFrame.unionByName, [found, *[d.select(*found.columns) for d in dealt]])


def common_support(rows: DataFrame, low: float = 0.5, high: float = 0.99) -> DataFrame:
    """Units whose share of the feature language lies in [low, high): where both classes can be found."""
    return rows.filter((F.col("feature_language_frac") >= low) & (F.col("feature_language_frac") < high))


CONTROL = "test string, arm string, roc_auc double, leaks boolean, n long"
LANGUAGES = ("click", "error", "purchase", "signup", "view")


def language_control(spark: SparkSession, sf_dir: str, majority: float = 0.2, leak: float = 0.70, mono: float = 0.25, min_class: int = MIN_CLASS, **fit) -> DataFrame:
    """Three questions about language: test, arm, roc_auc, leaks, n.

    A: does the language mix of the windows alone tell the classes? B: do an arm's features tell whether the
    feature language has the majority share? C: how do the arms do inside units of nearly one language? A class
    without enough units is not scored and has no row. The shares are those of the test tables' five languages.
    """
    rows = matrix(spark, sf_dir)
    units_kept = b.kept(spark, sf_dir)
    mix = units.matched(settled(sentiment.window_language_mix(read_events(spark, sf_dir), units_kept, LANGUAGES)), rows)
    alone = {"language": (*(f"lang_{x}" for x in LANGUAGES), "lang_n_distinct")}
    share = F.col("feature_language_frac")
    turned = rows.withColumn("label", (share >= majority).cast("int"))
    parts = [("A", mix, (Arm("language", ("language",)),), alone), ("B", turned, ARMS, None), ("C", rows.filter(share >= mono), ARMS, None)]
    found = []
    for test, own, arms, sets in parts:
        if large_enough(own, 2 * min_class, min_class):
            scored = settled(models.oof_scores(own, arms, sets=sets, **fit).select("arm", "label", "p"))
            sizes = scored.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
            found.append(evaluation.roc_auc(scored).join(sizes, "arm").withColumn("test", F.lit(test)).withColumn("leaks", (F.col("test") == "B") & (F.col("roc_auc") >= leak)))
    out = _union(found)
    return spark.createDataFrame([], CONTROL) if out is None else out.select(*[c.split()[0] for c in CONTROL.split(", ")])


def repeated_cv(rows: DataFrame, arm: Arm, repeats: int = 8, folds: int = 5, **fit) -> DataFrame:
    """Mean and spread of the scores over differently dealt folds: metric, mean, spread, repeats."""
    scored = models.replicated_scores(rows, arm, folds, [42 + r for r in range(repeats)], **fit).withColumn("arm", F.col("rep").cast("string"))
    scored = settled(scored.groupBy("arm", "label", "p").agg(F.sum("n").alias("n")))  # read by three scores, or fitted for each
    f1 = evaluation.threshold_metrics(scored).select("arm", "f1")
    each = evaluation.average_precision(scored).select("arm", "pr_auc").join(evaluation.roc_auc(scored).select("arm", "roc_auc"), "arm").join(f1, "arm")
    long = each.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("pr_auc", "roc_auc", "f1")])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"), F.count(F.lit(1)).alias("repeats"))


def permutation_test(rows: DataFrame, arm: Arm, shuffles: int = 100, folds: int = 5, **fit) -> DataFrame:
    """How many dealings of the labels score as well as the real one: pr_auc, n_as_good, p_value."""
    scored = models.replicated_scores(rows, arm, folds, [42 + r for r in range(shuffles + 1)], shuffled=True, **fit).withColumn("arm", F.col("rep").cast("string"))
    each = evaluation.average_precision(settled(scored.groupBy("arm", "label", "p").agg(F.sum("n").alias("n"))))  # read twice
    real = F.max(F.when(F.col("arm") == "0", F.col("pr_auc")))
    both = each.agg(real.alias("pr_auc"), F.collect_list(F.when(F.col("arm") != "0", F.col("pr_auc"))).alias("dealt"))  # a score for each shuffle
    good = F.size(F.filter("dealt", lambda x: x >= F.col("pr_auc")))
    return both.select("pr_auc", good.alias("n_as_good"), ratio(good + 1, F.size("dealt") + 1).alias("p_value"))
