"""Global order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import free, materialize


def running(df: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """``df`` with, for each ``name=column``, the sum of the column up to and with each row in the order of ``order``.

    Rows are range-partitioned, summed inside of each partition, and what lies before the partition is added: the only rows that
    one task sees together are a partition's, and one row for each partition. The ranges are written in the shared folder,
    so that a lost executor can't change them.
    """
    part, *before = free(df, "part", *(f"before_{i}" for i in range(len(sums))))
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*(F.sum(c).alias(b) for b, c in zip(before, sums.values())))
    totals = totals.select(part, *(F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in before))
    found = ranged.join(totals, part).select(*df.columns, *((F.sum(c).over(inside) + F.col(b)).alias(n) for b, (n, c) in zip(before, sums.items())))
    return found


def indexed(df: DataFrame, order: list[str], out: str = "image_index") -> DataFrame:
    """``df`` with each row's place, from 0."""
    (one,) = free(df, "one")
    found = running(df.withColumn(one, F.lit(1).cast("long")), order, **{out: one})
    return found.withColumn(out, F.col(out) - 1).drop(one)


def splits(df: DataFrame, index: str, count: int, total: int) -> DataFrame:
    """``df`` with ``split``, from 1: each split takes the rows left over the splits left, rounded up."""
    small, more = divmod(total, count)
    i = F.col(index)
    wide = more * (small + 1)
    split = F.when(i < wide, F.floor(i / (small + 1))) if not small else F.when(i < wide, F.floor(i / (small + 1))).otherwise(more + F.floor((i - wide) / small))
    return df.withColumn("split", (split + 1).cast("int"))


def schedule(df: DataFrame, index: str, nodes: int, total: int) -> DataFrame:
    """``df`` with ``node``: spans of ceil(total / nodes) rows; the last node takes what is left."""
    span = max(1, -(-total // nodes))
    return df.withColumn("node", F.least(F.floor(F.col(index) / span), F.lit(nodes - 1)).cast("int"))
