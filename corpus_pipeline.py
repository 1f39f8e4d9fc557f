"""The corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the documents it keeps with the
columns of ``documents``; the last returns the packing layout. ``run`` writes each stage's result in the shared folder and reads
it again, so a stage's lineage is one table; the table before is deleted then.

In every stage other columns are carried along whatever they are called, an empty table gives no rows, and rows with one id are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import langid, lines, mixing, packing, simhash
from lumenframe.llm._common import discard, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells apart; dictionaries come from a bounded sample of labelled rows of ``docs``.

    Null, empty and blank texts go, as nothing tells their language; so do ties. Very long texts are compressed whole, in pieces.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; ``n_chars`` follows the text. Documents that lose all but white space go; null and empty texts stay as they are."""
    return lines.drop_repeated_lines(docs, chars_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, of equal ids any. Texts without a word are near nothing and stay."""
    return simhash.drop_near_copies(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents let through by weighted fair queueing of their sources, to the weights of ``mixing.TARGETS``; a null source is one of its own."""
    return mixing.mix(docs, mixing.TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. Texts without a token have no piece."""
    return packing.pack_windows(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_to_weights),
    ("packing", pack),
]

#: SQL can't compress, fingerprint or pack; tests/llm/test_brute.py runs the five stages over one fixture and holds each against a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
