"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as Parquet in the
folder that executors share and reads it as the next stage's documents. All stages but the last return the
columns of ``documents``: the first drops documents that the fixed rules or the forest reject, the second
leaves one document of each near-duplicate group, the third replaces secrets in the texts. The last cuts
the texts' tokens into pieces packed into sequences.

Cases: an empty table passes through every stage; null texts fail the first stage; rows are otherwise
treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crestline.llm import neardup, packing, quality, secrets, storage
from crestline.llm.queries import BPE_50K


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(BPE_50K))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: Tokenizing and packing cannot be said in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what a stage leaves is removed when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        folder = storage.work_dir(spark, f"pipeline-{name}")
        mark = len(storage.made)
        docs = storage.written(stage(spark, docs, sf_dir), folder)
        storage.drop_since(spark, mark)
        if before is not None:
            storage.drop_dir(spark, before)
        storage.release(spark)
        before = folder
    return docs
