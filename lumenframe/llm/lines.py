"""Repeated line runs by a suffix array over line ids, built by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, free, keyed, materialize

#: A later copy goes if it has so many lines, or is one line of so many characters.
MIN_LINES, MIN_CHARS = 2, 30


def _later(own: DataFrame, key: str, id_col: str, text_col: str, min_lines: int, min_chars: int) -> DataFrame:
    """(key, doc_id, pos, reach): lines from ``pos`` on, ``reach`` of them, that a qualifying run of the same lines precedes somewhere.

    ``place`` orders all lines of all documents: id (null last), row, line number.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    line = F.col("line")
    rows = own.select(key, col(id_col).alias("doc_id"), F.posexplode(F.split(col(text_col), "\n", -1)).alias("pos", "line"))
    rows = materialize(rows.select(key, "doc_id", "pos", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"), F.char_length(line).alias("chars")), "lines")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key), "pos")

    def name(pairs: DataFrame) -> DataFrame:
        """Replaces (a, b) by its rank among all pairs that occur twice or more; pairs that occur once leave."""
        groups = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
        groups = groups.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id())
        found = pairs.join(materialize(groups, "ranks"), ["a", "b"]).withColumn("later", F.col("first") != place)
        return materialize(found.select(key, "doc_id", "pos", "chars", "rank", "later"), "ranked")

    ranked, k, found = name(rows), 1, None
    while True:
        qualifies = F.col("later") if k >= min_lines else F.col("later") & ((F.col("chars") >= min_chars) if k == 1 else F.lit(False))
        here = ranked.filter(qualifies).select(key, "doc_id", "pos", F.lit(k).alias("reach"))
        found = here if found is None else found.unionAll(here)
        if ranked.isEmpty():
            return found.groupBy(key, "doc_id", "pos").agg(F.max("reach").alias("reach"))
        ahead = Window.partitionBy(key).orderBy("pos").rangeBetween(k, k)
        pairs = ranked.withColumn("b", F.max("rank").over(ahead)).filter("b is not null")
        ranked, k = name(pairs.select(key, "doc_id", "pos", "chars", F.col("rank").alias("a"), "b")), 2 * k


def _deleted(later: DataFrame, key: str) -> DataFrame:
    """(key, doc_id, start, end): the stretches of deleted lines, ``end`` excluded, made one where they touch or overlap."""
    w = Window.partitionBy(key).orderBy("pos")
    past = F.max(F.col("pos") + F.col("reach")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(past.isNull() | (F.col("pos") > past), 1).otherwise(0)
    runs = later.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "doc_id", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("reach")).alias("end")).drop("run")


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Stretches of lines to delete, one row each: ``doc_id``, ``start_line`` (from 0), ``n_lines``.

    Lines (between line feeds, compared as they are) get ids, and all suffixes of all documents' sequences of ids are sorted by prefix
    doubling: the rank of 2k lines comes from the ranks of k lines here and k lines further on. A rank that occurs once is dropped at
    once, and nothing that contains it is looked at again, so rounds shrink, and end when no run of 2k lines repeats. Rows that share a
    rank at k lines are an interval of the suffix array with a common prefix of k lines or more; all but its first member, in order
    of id (null last), row and line, are later copies. A maximal run of any length is the union of its intervals at powers of two.

    A later copy qualifies with ``min_lines`` lines or more (a power of two), or if it is a single line of ``min_chars`` characters or more.
    Runs may overlap their first copy (a line repeated on end keeps its first). Line ids are 128 bits of two hashes. Null texts have no
    lines; the empty text has one empty line. Rows that are equal throughout are copies of each other. An empty table gives no rows.
    """
    (key,) = free(docs, "key")
    later = _later(keyed(docs, key), key, id_col, text_col, min_lines, min_chars)
    return _deleted(later, key).select("doc_id", F.col("start").alias("start_line"), (F.col("end") - F.col("start")).alias("n_lines"))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str | None = None,
    min_lines: int = MIN_LINES,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` without the lines of ``repeated_runs``; rows that lose all but white space go. ``chars_col``, if given, is counted anew.

    Rows that lose no line stay as they are, null and empty texts too. Other columns stay as they are.
    """
    key, gone = free(docs, "key", "gone")
    own = keyed(docs, key)
    runs = _deleted(_later(own, key, id_col, text_col, min_lines, min_chars), key)
    runs = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(gone))
    rows = own.join(runs.hint("shuffle_hash"), key, "left")
    between = lambda x: F.zip_with(  # noqa: E731  the stretches of lines that stay, from each deleted one's end to the next one's start
        F.concat(F.array(F.lit(0)), F.col(gone)["end"]), F.concat(F.col(gone)["start"], F.array(F.size(x))), lambda a, b: F.slice(x, a + 1, b - a)
    )
    split = F.array(F.split(col(text_col), "\n", -1))  # bound once by transform, not split again for each stretch
    kept = F.transform(split, lambda x: F.array_join(F.flatten(between(x)), "\n"))[0]
    text = F.when(F.col(gone).isNull(), col(text_col)).otherwise(kept)
    rows = rows.withColumn(text_col, text).filter(F.col(gone).isNull() | (F.trim(F.translate(col(text_col), "\n\r\t", "   ")) != ""))
    if chars_col:
        rows = rows.withColumn(chars_col, F.when(F.col(gone).isNull(), col(chars_col)).otherwise(F.char_length(col(text_col))).cast(docs.schema[chars_col].dataType))
    return rows.select(*(col(c) for c in docs.columns))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, CAST(unnest(range(len(lines))) AS INTEGER) AS pos FROM d),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AND length(line) >= 30 AS one,
        next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) > 1 AS two FROM n),
g AS (SELECT *, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM r),
s AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g WHERE gone)
SELECT doc_id, min(pos) AS start_line, CAST(count(*) AS INTEGER) AS n_lines FROM s GROUP BY doc_id, run
"""
