"""One query for each corpus operator, over its whole table, and the SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact, langid, lines, media, mixing, packing, sharding, simhash, substring, toxicity
from ._common import col


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_docs(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_docs(spark, sf_dir), mixing.TARGETS)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_docs(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_windows(_docs(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_runs(_docs(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' bytes stand for telephone calls: no table holds audio, and every byte is a sample under either law."""
    return media.store_pcm(_docs(spark, sf_dir), col("text"), media.as_calls())


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_docs(spark, sf_dir))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_media": op9_media,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}
ORACLE_SQL = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_exact_dedup": exact.ORACLE_SQL,
    "op8_line_dedup": lines.ORACLE_SQL,
}
