"""Helpers shared by the corpus operators: row keys, tokens, running sums."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import col, discard, free, materialize, shared_dir

__all__ = ["TOKEN", "col", "discard", "free", "int_id", "keyed", "materialize", "n_tokens", "running_sum", "shared_dir"]

#: A token is a run of characters other than blank, tab, line feed and carriage return.
TOKEN = "[^ \\t\\n\\r]+"


def int_id(name: str) -> Column:
    """The id as a 64-bit integer; one that isn't an integer counts as null."""
    return col(name).try_cast("long")


def _rows_of_one_scan(df: DataFrame) -> bool:
    """True where each row is one row of a Parquet scan, met once: filters and projections above one path, all deterministic."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if kind != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().location().rootPaths().size() == 1


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a struct ``key`` that differs for any two rows and that every retry and every reading gives alike.

    It is the file and the place of the row in it, where a row is a row of one scan. All other rows (of joins, unions, exploded or
    drawn ones, a path read twice, other formats) are first written in the shared folder, as equal rows of a file could stand behind several.
    """
    def place(df: DataFrame) -> DataFrame:
        m = df.metadataColumn("_metadata")
        return df.select("*", F.struct(F.xxhash64(m["file_path"]).alias("f"), m["row_index"].alias("r")).alias(key))

    if _rows_of_one_scan(docs):
        try:
            found = place(docs)
            found.schema  # noqa: B018  analysed here
            return found
        except AnalysisException:
            pass
    return place(materialize(docs, "rows"))


def n_tokens(text: str = "text") -> Column:
    """Tokens (see TOKEN) of the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, out: str, value: str, order: list[str], group: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in the order of ``order``, within each ``group``.

    A group isn't held by one task: rows are range-partitioned by group and order, each partition is summed, and what lies before a
    partition is added to the sums inside of it. ``order`` must tell any two rows apart that differ in anything that counts.
    """
    pid, total, before = free(df, "pid", "total", "before")
    by = ([group] if group else []) + order
    ranged = materialize(df.repartitionByRange(*by).withColumn(pid, F.spark_partition_id()), "ranges")
    keys = [pid] + ([group] if group else [])
    sums = ranged.groupBy(*keys).agg(F.sum(value).alias(total))
    w = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum(total).over(w), F.lit(0)).alias(before))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(sums, keys).withColumn(out, F.sum(value).over(inside) + F.col(before)).drop(pid, before)
