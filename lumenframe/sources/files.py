"""Folders of image files, URL lists and tab-separated photo lists; decoded pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codecs import exif as tags
from ..codecs import jpeg, matrix, netpbm, payloads, png
from ..codecs.payloads import pixels_of
from ..functions.text import base_name, suffix, tsv_meta

PHOTO_COLUMNS = (
    "photo_id user_nsid user_nickname date_taken date_uploaded capture_device title description user_tags machine_tags longitude latitude accuracy "
    "page_url download_url license_name license_url server_id farm_id secret secret_original extension marker"
).split()
_READERS = {1: jpeg.read_header, 2: png.read_header, 3: netpbm.read_header}


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "bands")]))
def read_header(payload: pd.Series, storage_format: pd.Series) -> pd.DataFrame:
    """Sizes from the encoded bytes; null where they can't be read."""

    def one(data: bytes, kind: int):
        try:
            return _READERS[kind](bytes(data)) or (None, None, None)
        except (ValueError, KeyError, StopIteration, TypeError):
            return None, None, None

    return pd.DataFrame([one(d, k) for d, k in zip(payload, storage_format)], columns=["width", "height", "bands"]).astype("Int32")


# Arrow functions: the workers of pandas ones import pandas, half of the memory of a worker.
@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Linear pixels of JPEG, PNG and PPM payloads; null where they can't be decoded."""
    n = np.arange(256) / 255
    linear = np.where(n <= 0.04045, n / 12.92, ((n + 0.055) / 1.055) ** 2.4).astype(np.float32)
    return payloads.decoded(batches, lambda x: linear[x].ravel(), payloads.floats)


@F.arrow_udf(T.BinaryType())
def encode(pixels: pa.Array, width: pa.Array, height: pa.Array, storage_format: pa.Array) -> pa.Array:
    """Encoded payloads from sRGB bytes of three bands; null where there are no pixels. Other sizes or formats are an error."""
    return payloads.binary([payloads.encoded(*(x.as_py() for x in row)) for row in zip(pixels, width, height, storage_format)])


@F.arrow_udf(T.BinaryType())
def decode_bytes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """sRGB pixels of JPEG, PNG and PPM payloads, a byte each; null where they can't be decoded."""
    return payloads.decoded(batches, np.ndarray.tobytes, payloads.binary)


def decoded(images: DataFrame, image_type: str = "float") -> DataFrame:
    """``images`` with ``pixels`` in place of ``payload``: linear floats (``float``) or sRGB bytes (``byte``); ``raw`` leaves the payload.

    Another type is an error, and so is a storage format without decoder. Images whose payload can't be decoded, or has another size than
    the header says, have null pixels. Filters on header columns are run before any decoding.
    """
    if image_type == "raw":
        return images
    if image_type not in ("float", "byte"):
        raise ValueError(f"unknown image type {image_type}")
    known = F.when(F.col("storage_format").isin(*payloads.DECODERS), F.col("storage_format")).otherwise(F.raise_error(F.lit("no decoder for this storage format")))
    made = (decode if image_type == "float" else decode_bytes)("payload", known)
    size = F.size("pixels") if image_type == "float" else F.octet_length("pixels")
    fits = size == F.col("width") * F.col("height") * F.col("bands")
    return images.withColumn("pixels", made).withColumn("pixels", F.when(fits, F.col("pixels"))).drop("payload")


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def exif(payload: pa.Array, storage_format: pa.Array) -> pa.Array:
    """EXIF tags of JPEG and PNG payloads by name, as texts; an empty map where there are none or they can't be read."""

    def one(data: bytes, kind: int) -> dict[str, str]:
        try:
            return tags.read(bytes(data), kind)
        except (ValueError, TypeError, struct.error):
            return {}

    return payloads.texts([one(d.as_py(), k.as_py()) for d, k in zip(payload, storage_format)])


@F.pandas_udf(T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("type", "rows", "cols")), T.StructField("data", T.ArrayType(T.DoubleType()))]))
def decode_matrix(payload: pd.Series) -> pd.DataFrame:
    """Matrices from the bytes of matrix files; null where they can't be read. Elements go row by row, channels last."""

    def one(data: bytes) -> tuple:
        try:
            m = matrix.decode(bytes(data))
            return struct.unpack_from(">i", data)[0], m.shape[0], m.shape[1], m.astype(float).ravel()
        except (ValueError, KeyError, TypeError, struct.error):
            return None, None, None, None

    return pd.DataFrame([one(d) for d in payload], columns=["type", "rows", "cols", "data"]).astype({c: "Int32" for c in ("type", "rows", "cols")})


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """The matrix files at ``path``: ``path``, ``type``, ``rows``, ``cols``, ``data``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_matrix("content").alias("m")).select("path", "m.*")


def format_of(path: Column) -> Column:
    kind = suffix(path)
    return F.when(kind.isin("jpg", "jpeg"), 1).when(kind == "png", 2).when(kind == "ppm", 3)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Headers and payloads of the image files in ``folder``, with ``path``; files whose header can't be read are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kinds = files.select("path", format_of(F.col("path")).alias("storage_format"), F.col("content").alias("payload")).filter("storage_format is not null")
    found = kinds.withColumn("head", read_header("payload", "storage_format")).filter("head.width is not null")
    meta = F.create_map(F.lit("source"), "path", F.lit("filename"), base_name(F.col("path")))
    return found.select("path", "storage_format", F.lit(1).alias("color_space"), "head.*", meta.alias("meta"), "payload")


def jpeg_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded files of ``folder`` by Spark's ``image`` source: origin, sizes and bytes in the order blue, green, red."""
    return spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def photo_list(spark: SparkSession, path: str, videos: bool = False) -> DataFrame:
    """The 23 tab-separated columns as text, and ``meta`` with ``col_000`` on; videos (marker 1) are left out."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).filter(F.size(parts) == len(PHOTO_COLUMNS))
    found = rows.select(*(parts[i].alias(c) for i, c in enumerate(PHOTO_COLUMNS)), tsv_meta(F.col("value")).alias("meta"))
    return found if videos else found.filter("marker <> '1'")


def images_named(path: str) -> int:
    """The number of images that a photo list's file name tells, as its second part between dashes; another name is an error."""
    parts = path.rpartition("/")[2].split("-")
    if len(parts) < 2 or not parts[1].isdigit():
        raise ValueError(f"{path} doesn't name its number of images")
    return int(parts[1])
