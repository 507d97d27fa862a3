"""The report: eleven sections, each a small table of one study, as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import config
from crestline.operators import evaluation, models, prototype, units
from crestline.plans import bindings as b
from crestline.plans import studies
from crestline.sources import sinks
from crestline.sources.posts import read_events, with_previous

PLACES = 3


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, PLACES).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def feature_list(spark: SparkSession, audit: DataFrame) -> DataFrame:
    """Each feature with its set, and what the audit says of it."""
    listed = [(c, name) for name, own in config.FEATURE_SETS.items() for c in own]
    return spark.createDataFrame(listed, "feature string, set string").join(audit, "feature", "left").orderBy("set", "feature")


def sections(spark: SparkSession, sf_dir: str, **fit) -> list[tuple[str, DataFrame]]:
    """Titles and tables in the report's order; ``fit`` goes to the models."""
    matrix = b.matrix_of(spark, sf_dir).cache()
    given = [c for own in config.FEATURE_SETS.values() for c in own]
    lead = studies.lead_time(spark, sf_dir, **fit)
    robust = studies.robustness(spark, sf_dir, **fit)
    support = studies.common_support(matrix)
    inside = studies.evaluate(support, **fit) if studies.large_enough(support) else support.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    audit = evaluation.size_audit(matrix, [c for c in given if c != config.VOLUME_PROXY], config.VOLUME_PROXY)
    fusion = config.arm_columns(next(a for a in config.ARMS if a.name == "full_fusion"))
    early = prototype.early_features(with_previous(read_events(spark, sf_dir)))
    return [
        ("Arms compared", studies.ablation(matrix, **fit)),
        ("Lead times, each with its own units", lead.filter(F.startswith("setting", F.lit("lead_")))),
        ("Lead times over the same units", lead.filter(F.startswith("setting", F.lit("nested_")))),
        ("What language alone explains", studies.language_control(spark, sf_dir, **fit)),
        ("Arms where both classes share a language", inside),
        ("Fewest posts in a window", robust.filter(F.startswith("setting", F.lit("min_window_")))),
        ("Length of the window", robust.filter(F.startswith("setting", F.lit("window_")))),
        ("Units and why topics are dropped", units.attrition(b.judged(spark, sf_dir)).orderBy("label", "step")),
        ("The early study's features by class", early.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("unique_users", "density", "reciprocity", "mean_clustering")])),
        ("Importance by shuffling", models.top_importances(models.permutation_importance(matrix, fusion, **fit))),
        ("Features, their sets and their size audit", feature_list(spark, audit)),
    ]


def build(spark: SparkSession, sf_dir: str, **fit) -> str:
    return sinks.report([(title, _rounded(df)) for title, df in sections(spark, sf_dir, **fit)])
