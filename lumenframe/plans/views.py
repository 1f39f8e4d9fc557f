"""The driver's tables seen as images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codecs import exif, payloads


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Three-band pixels in long form: an order is an image, a line a pixel."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_index"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") / 50).alias("r"), F.col("l_discount").alias("g"), F.col("l_tax").alias("b")
    )


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """Image headers from orders; no payload."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_index"), (1 + F.col("o_orderkey") % 3).cast("int").alias("storage_format"), F.lit(1).alias("color_space"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("width"), (1 + F.col("o_custkey") % 3000).cast("int").alias("height"), F.lit(3).alias("bands"),
        F.create_map(F.lit("source"), F.col("o_orderpriority")).alias("meta"),
    )


HEADERS_SQL = """h AS (SELECT o_orderkey AS image_index, CAST(1 + o_orderkey % 3 AS INTEGER) AS storage_format, 1 AS color_space,
  CAST(floor(o_totalprice / 100) AS INTEGER) AS width, CAST(1 + o_custkey % 3000 AS INTEGER) AS height, 3 AS bands, o_orderpriority AS source FROM orders)"""


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 images of one band from embeddings."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_index"), (1 + F.col("label") % 3).cast("int").alias("storage_format"), F.lit(2).alias("color_space"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("bands"), F.col("embedding").cast("array<double>").alias("pixels"),
    )


#: (image_index, pos, v) of the rasters.
LONG_SQL = "e AS (SELECT vec_id AS image_index, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


#: (image_index, format, pos, v): the bytes of the images of ``encoded``, alike in all bands.
BYTES_SQL = """p AS (SELECT vec_id AS image_index, CAST(1 + label % 3 AS INTEGER) AS format, CAST(unnest(range(64)) AS INTEGER) AS pos,
  CAST(floor(greatest(0, least(255, 128 + 300 * CAST(unnest(embedding) AS DOUBLE)))) AS INTEGER) AS v FROM embeddings)"""


@F.arrow_udf(T.StructType([T.StructField("truth", T.BinaryType()), T.StructField("payload", T.BinaryType())]))
def _made(values: pa.Array, kind: pa.Array, model: pa.Array) -> pa.Array:
    """Three equal bands of bytes from values around 0, and the 8 x 8 image of them, encoded.

    JPEGs have the camera's model in an EXIF segment; null leaves them. It is one function so that a task has one Python worker for it.
    """
    cells = np.repeat(np.floor(np.clip(128 + 300 * payloads.numbers(values.values, np.float64), 0, 255)).astype(np.uint8), 3)
    ends = (3 * payloads.numbers(values.offsets, np.int32)).tolist()
    truth, payload = [cells[a:b].tobytes() for a, b in zip(ends, ends[1:])], []
    for t, k, m in zip(truth, kind, model):
        p, m = payloads.encoded(t, 8, 8, k.as_py()), m.as_py()
        payload.append(p if m is None else p[:2] + exif.block({0x0110: m}) + p[2:])
    return pa.StructArray.from_arrays([payloads.binary(truth), payloads.binary(payload)], ["truth", "payload"])


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as 8 x 8 images of three bands, encoded as JPEG, PNG and PPM by turns of the label; ``truth`` has the bytes that were encoded.

    Every JPEG has the EXIF model ``Camera`` with its label.
    """
    kind = (1 + F.col("label") % 3).cast("int")
    model = F.when(kind == 1, F.concat(F.lit("Camera "), F.col("label").cast("string")))
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_index"), kind.alias("storage_format"), F.lit(1).alias("color_space"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(3).alias("bands"),
        F.create_map(F.lit("source"), F.col("vec_id").cast("string")).alias("meta"), "label", _made(F.col("embedding").cast("array<double>"), kind, model).alias("made"),
    )
    return rows.select("*", "made.truth", "made.payload").drop("made")
