"""Results to files: small results as JSON and a Markdown report, tables as Parquet, keyed caches extended in place, rows kept between steps."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Results with more rows than this are tables and are written as Parquet.
MAX_ROWS = 10_000


def small_rows(df: DataFrame, limit: int = MAX_ROWS) -> list[dict]:
    """The rows of a summary; raises ValueError for more than ``limit``."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write it as a table")
    return rows


def write_json(df: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps(small_rows(df), indent=2, default=str))


def extend_cache(spark: SparkSession, path: str, fresh: DataFrame, key: str = "key") -> DataFrame:
    """Append the rows whose key the cache at ``path`` lacks; a missing cache is empty."""
    try:
        have = spark.read.parquet(path).select(key)
    except Exception as e:  # Spark names the missing path in its error class
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    (fresh if have is None else fresh.join(have, key, "left_anti")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The rows kept under a plan that holds nothing of how they were made, so that plans on top of it stay small.

    They go to the checkpoint folder; a local session without one keeps them in the executors' storage.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def spread(spark: SparkSession) -> int:
    """Partitions for rows that are few and costly: as many as shuffles have, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_units(units: DataFrame, path: str) -> None:
    """Units as a table, replaced as a whole."""
    units.write.mode("overwrite").parquet(path)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units as they were written; raises ValueError for a table that is none."""
    rows = spark.read.parquet(path)
    if lacking := {"topic", "label", "peak_bin", "window_start_bin", "window_end_bin"} - set(rows.columns):
        raise ValueError(f"not a table of units, it lacks {sorted(lacking)}")
    return rows


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    rows = small_rows(df, limit)
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}"
    return "\n".join([head, *("| " + " | ".join("" if r[c] is None else str(r[c]) for c in df.columns) + " |" for r in rows)])


def report(sections: list[tuple[str, DataFrame]], title: str = "Results") -> str:
    """A numbered Markdown report of small results."""
    return "\n\n".join([f"# {title}", *(f"## {n}. {name}\n\n{markdown_table(df)}" for n, (name, df) in enumerate(sections, 1))]) + "\n"


def signed(value: float, places: int = 3) -> str:
    """A difference with its sign."""
    return f"{value:+.{places}f}"


def as_json_column(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
