"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BPE_50K = "byte_bpe_50k.json"
BPE_MULTI_50K = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .records import token_records

    return token_records(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_50K))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_50K))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixtree import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .additive import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .unibytes import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_MULTI_50K), public_tokenizers.PATTERN)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_documents

    return scan_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import neardup, warc

    return {"op2_warc": warc.ORACLE_SQL, "op5_near_duplicates": neardup.ORACLE_SQL}
