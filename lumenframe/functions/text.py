"""Bytes, names and printed forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COLOR_SPACES, STORAGE_FORMATS, enum_name


def digest(data: Column, compat: bool = False) -> Column:
    """SHA-1 in hexadecimal; ``compat`` prints each byte without its leading zero."""
    h = F.sha1(data)
    if not compat:
        return h
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(39), F.lit(2)), lambda i: F.regexp_replace(F.substr(h, i, F.lit(2)), "^0", "")), "")


def byte_dump(data: Column, n: int) -> Column:
    """The first n bytes as ``0xAB 0xCD``."""
    return F.trim(F.regexp_replace(F.hex(F.substring(data, 1, n)), "(..)", "0x$1 "))


def int_to_bytes(x: Column) -> Column:
    """4 bytes, high first."""
    return F.unhex(F.lpad(F.right(F.hex(x.cast("long")), F.lit(8)), 8, "0"))


def bytes_to_int(b: Column) -> Column:
    n = F.conv(F.hex(b), 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def byte_at(data: Column, i: Column) -> Column:
    """The byte at place ``i`` (from 0) as 0 to 255."""
    return F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")


def raw_string(payload: Column) -> Column:
    """``RawImage: w x h x b`` and the first ten bytes of the payload at most."""
    return F.concat(F.format_string("RawImage: %d x %d x %d [", "width", "height", "bands"), byte_dump(payload, 10), F.lit("]"))


def header_string() -> Column:
    """``ImageHeader: (format space) w x h x b meta: json``."""
    names = enum_name(F.col("storage_format"), STORAGE_FORMATS), enum_name(F.col("color_space"), COLOR_SPACES)
    return F.format_string("ImageHeader: (%s %s) %d x %d x %d meta: %s", *names, "width", "height", "bands", F.to_json("meta"))


def raster_string(pixels: Column, kind: str = "FloatImage") -> Column:
    """``FloatImage: w x h x b`` and the first ten pixels at most."""
    bands = F.col("bands")
    count = F.least(F.lit(10), F.col("width") * F.col("height"))
    one = lambda i: F.concat(F.lit("("), F.array_join(F.transform(F.slice(pixels, i * bands + 1, bands), lambda v: F.format_string("%.2f", v.cast("double"))), " "), F.lit(")"))
    return F.concat(F.format_string(f"{kind}: %d x %d x %d [", "width", "height", "bands"), F.array_join(F.transform(F.sequence(F.lit(0), count - 1), one), " "), F.lit("]"))


def dump_line(source: Column, model: Column) -> Column:
    """``WxH``, the source in brackets and the camera's model, parted by tabs; ``null`` where one is missing."""
    return F.format_string("%dx%d\t(%s)\t  %s", "width", "height", F.coalesce(source, F.lit("null")), F.coalesce(model, F.lit("null")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case letters after the last dot of the base name; empty where there is no dot."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def tsv_meta(line: Column) -> Column:
    """A map ``col_000``, ``col_001``, ... of a line's fields."""
    parts = F.split(line, "\t", -1)
    return F.map_from_arrays(F.transform(parts, lambda _, i: F.format_string("col_%03d", i)), parts)
