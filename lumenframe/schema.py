"""The image table: header columns, string maps, and the payload or the pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORAGE_FORMATS = {0: "UNDEFINED", 1: "JPEG", 2: "PNG", 3: "PPM"}
COLOR_SPACES = {0: "UNDEFINED", 1: "RGB", 2: "LUM"}
IMAGE_TYPES = {0: "UNDEFINED", 1: "FLOAT", 2: "BYTE", 3: "RAW"}
#: Bytes of an element by pixel type: byte, unsigned short, short, int, float, double.
TYPE_SIZES = {0: 1, 1: 2, 2: 2, 3: 4, 4: 4, 5: 8}

_STRINGS = T.MapType(T.StringType(), T.StringType())
HEADER = T.StructType(
    [T.StructField("image_index", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("storage_format", "color_space", "width", "height", "bands")), T.StructField("meta", _STRINGS)]
)
RAW = T.StructType([*HEADER.fields, T.StructField("payload", T.BinaryType())])


def enum_name(value: Column, names: dict[int, str]) -> Column:
    """The name of an enum's number; another number is an error."""
    found = F.when(value == min(names), names[min(names)])
    for k, v in names.items():
        found = found.when(value == k, v)
    return found.otherwise(F.raise_error(F.concat(F.lit("unknown enum value "), value.cast("string"))))


def enum_value(name: Column, names: dict[int, str]) -> Column:
    """The number of an enum's name; another name is an error."""
    found = F.when(name == names[min(names)], F.lit(min(names)))
    for k, v in names.items():
        found = found.when(name == v, F.lit(k))
    return found.otherwise(F.raise_error(F.concat(F.lit("unknown enum name "), name)))


def valid() -> Column:
    """True for headers whose sizes are 1 or more; what is encoded or shown must pass it."""
    return (F.col("width") >= 1) & (F.col("height") >= 1) & (F.col("bands") >= 1)
