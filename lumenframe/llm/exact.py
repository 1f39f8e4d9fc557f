"""Exact duplicates by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, free, materialize

#: Bytes of the digits: each next one is GROWTH times as long, up to LONGEST.
FIRST, GROWTH, LONGEST = 32, 8, 1 << 20


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``keep_id`` (least id among all rows with just this text), ``copies`` (their number).

    Documents are split by their successive bytes, most significant first, until a group has one member or its texts have ended; no
    digest is taken, equal means equal bytes. Each text is read as its length followed by its bytes, so the end of a text is a digit
    like any other. A round takes one digit: the length and 32 bytes, then 256 bytes, 2,048 and so on (1 MiB at most). A round counts
    (group, digit) with partial aggregation and joins the groups of two or more back; what stands alone leaves with its remaining text
    dropped, so later rounds carry only texts that have a partner so far. Group numbers come from a table in the shared folder. The join
    shuffles at every size rather than being broadcast where the groups are few.

    Null texts form one group, apart from the empty text. Null ids count as rows but are kept only where a group has no other. Equal
    rows are copies of each other. An empty table gives no rows. Other columns aren't read.
    """
    size, rest, digit, gid, new, least, n = free(docs, "size", "rest", "digit", "gid", "new", "least", "n")
    text = col(text_col).cast("binary")
    rows = docs.select(
        col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(-1)).alias(size), F.coalesce(text, F.lit(b"").cast("binary")).alias(rest)
    )
    done, width, covered, keys = [], FIRST, FIRST, [size, digit]
    while True:
        cut = F.substring(F.col(rest), 1, width)
        split = rows.withColumn(digit, cut)
        groups = split.groupBy(*keys).agg(F.count("*").alias(n), F.min("doc_id").alias(least)).filter(F.col(n) > 1)
        groups = materialize(groups.withColumn(new, F.monotonically_increasing_id()), "groups")
        now = split.join(groups.hint("shuffle_hash"), keys, "left")
        now = now.select(
            "doc_id", size, F.col(new).alias(gid), F.col(least), F.col(n),
            F.when(F.col(new).isNotNull() & (F.col(size) > covered), F.expr(f"substring({rest}, {width + 1})")).alias(rest),
        )
        now = materialize(now, "split")
        open_ = F.col(rest).isNotNull()
        done.append(now.filter(~open_).select(
            "doc_id", F.when(F.col(gid).isNull(), F.col("doc_id")).otherwise(F.col(least)).alias("keep_id"), F.coalesce(n, F.lit(1)).cast("long").alias("copies")
        ))
        rows = now.filter(open_).select("doc_id", size, gid, rest)
        if rows.isEmpty():
            break
        width = min(width * GROWTH, LONGEST)
        covered += width
        keys = [gid, digit]
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


ORACLE_SQL = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies FROM documents
"""
