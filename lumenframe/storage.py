"""Tables in the folder that all executors share, which cut lineage, and names that clash with no column."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine) gets a folder of its own, removed at exit; a cluster is refused, as no folder of
    one machine can survive the loss of that machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lumenframe-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage is cut and any retry sees the same rows."""
    path = f"{shared_dir(df.sparkSession)}/lumenframe/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``tables``; nothing that still is to run may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    prefix = "_lf"
    while any(c.startswith(prefix) for c in taken):
        prefix += "x"
    return [f"{prefix}_{w}" for w in wanted]


def col(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
