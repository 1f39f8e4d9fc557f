"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, free, keyed, materialize, n_tokens, running_sum

#: Target weights of the sources that the query and the pipeline mix to; other sources have WEIGHT.
TARGETS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 0.5}
#: Share of all tokens that is kept where no budget is given; seed of the shuffle; weight of a source that ``weights`` doesn't name.
BUDGET_SHARE, SEED, WEIGHT = 0.8, 17, 1.0


def _weight(source: Column, weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(WEIGHT)
    if min(weights.values()) <= 0:
        raise ValueError("weights must be above 0")
    return F.coalesce(F.create_map(*map(F.lit, chain(*weights.items())))[source], F.lit(WEIGHT)).cast("double")


def _queue(rows: DataFrame, weights: dict[str, float] | None, budget: int | None) -> DataFrame:
    """``rows`` (doc_id, source, n_tokens, ...) that the budget lets through, with finish_time and end_token; ``free`` names aside."""
    flow, draw = free(rows, "flow", "draw")
    rows = rows.withColumn(flow, F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))))
    rows = rows.withColumn(draw, F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = running_sum(rows, "finish_time", "n_tokens", [draw, "doc_id", "n_tokens"], flow)
    rows = rows.withColumn("finish_time", F.col("finish_time") / _weight(F.col("source"), weights))
    rows = running_sum(rows, "end_token", "n_tokens", ["finish_time", draw, "doc_id", "n_tokens"])
    rows = materialize(rows, "queue")
    if budget is None:
        budget = int(BUDGET_SHARE * (rows.agg(F.max("end_token")).first()[0] or 0))
    return rows.filter(F.col("end_token") <= budget).orderBy("finish_time", draw, "doc_id", "n_tokens").drop(flow, draw)


def mix_plan(
    docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """The documents that are let through, in order: ``doc_id``, ``source``, ``n_tokens``, ``finish_time``, ``end_token``.

    Each source's documents are shuffled by the MD5 of seed and id. A document's virtual finish time is the tokens of its source up to
    and with itself, divided by the weight of the source. All documents are range-sorted by it and let through until their tokens
    (``end_token`` sums them) would pass ``budget``, by default BUDGET_SHARE of all. A source that runs out leaves its share to the
    others. Neither a hot source nor the global order is summed by one task: partitions are summed apart (``running_sum``).

    Tokens are counted over whole texts; null and empty texts have none and pass while the budget lasts. A null source is a source of
    its own with the default weight. Ties go by MD5, id and tokens; of rows equal in these, any. Rows with one id are shuffled as one.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), n_tokens(text_col).alias("n_tokens"))
    return _queue(materialize(rows, "tokens"), weights, budget)


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """``docs`` that ``mix_plan`` lets through, all columns as they are, range-sorted by virtual finish time."""
    key, rank = free(docs, "key", "rank")
    own = keyed(docs, key)
    rows = own.select(F.col(key), col(id_col).alias("doc_id"), col(source_col).alias("source"), n_tokens(text_col).alias("n_tokens"))
    plan = _queue(materialize(rows, "tokens"), weights, budget).select(key, F.struct("finish_time", "end_token").alias(rank))
    return own.join(plan.hint("shuffle_hash"), key).orderBy(rank).drop(key, rank)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n_tokens, md5('17:' || doc_id) AS h FROM documents
), v AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
    / CAST(CASE source WHEN 'src0' THEN 4.0 WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 2.0 WHEN 'src3' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS finish_time FROM d
), q AS (
  SELECT *, CAST(sum(n_tokens) OVER (ORDER BY finish_time, h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_token FROM v
)
SELECT doc_id, source, n_tokens, finish_time, end_token FROM q
WHERE end_token <= CAST(floor(0.8 * (SELECT sum(n_tokens) FROM d)) AS BIGINT)
"""
