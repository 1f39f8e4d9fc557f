"""Pixel arithmetic as Column expressions; arrays are flat, (y * width + x) * bands + band."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_byte(x: Column) -> Column:
    """0..1 to 0..255 by truncation; clamped before the cast, which would fail on overflow."""
    return clamp(x * 255, 0.0, 255.0).cast("int")


def clamp_byte(x: Column) -> Column:
    return clamp(x, 0, 255).cast("int")


def from_byte(x: Column) -> Column:
    return x / F.lit(255.0)


def srgb_to_linear(byte: Column) -> Column:
    """Gamma expansion of 0..255 (clamped) to 0..1."""
    n = clamp_byte(byte) / F.lit(255.0)
    return F.when(n <= 0.04045, n / 12.92).otherwise(F.pow((n + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    """Gamma compression of 0..1 to 0..255, in 2048 levels."""
    level = (clamp(x * 2047 - 0.5, 0.0, 2047.0).cast("int") + 0.5) / F.lit(2047.0)
    s = F.when(level <= 0.0031308, level * 12.92).otherwise(1.055 * F.pow(level, F.lit(1 / 2.4)) - 0.055)
    return clamp(s * 255, 0.0, 255.0).cast("int")


def luminance(r: Column, g: Column, b: Column, compat: bool = False) -> Column:
    """.30 r + .59 g + .11 b; ``compat`` gives what reading the first band three times gives, which is r."""
    return r if compat else 0.30 * r + 0.59 * g + 0.11 * b


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def rgb_to_lum(pixels: Column, compat: bool = False) -> Column:
    """One band from three."""
    at = lambda i, c: F.get(pixels, i * 3 + c)
    return F.transform(F.sequence(F.lit(0), (F.size(pixels) / 3).cast("int") - 1), lambda i: luminance(at(i, 0), at(i, 1), at(i, 2), compat))


#: Columns of a header that two images must share before their pixels can meet.
SHAPE = ("width", "height", "bands", "color_space")


def shape(image: Column | None = None) -> Column:
    """Width, height, bands and colour space as a struct, of the header columns or of the struct ``image``."""
    return F.struct(*((F.col(c) if image is None else image[c]).alias(c) for c in SHAPE))


def _same(a: Column, b: Column, shapes: tuple[Column, Column] | None) -> Column:
    """``a``, or an error where shapes (or, without them, numbers of elements) differ."""
    fits = F.size(a) == F.size(b)
    if shapes:
        fits = fits & (shapes[0] == shapes[1])
    return F.when(fits, a).otherwise(F.raise_error(F.lit("images differ in width, height, bands or colour space")))


def add(a: Column, b: Column, shapes: tuple[Column, Column] | None = None) -> Column:
    """Sums of elements; ``shapes`` are the ``shape`` of both images, and an error where they differ."""
    return F.zip_with(_same(a, b, shapes), b, lambda x, y: x + y)


def multiply(a: Column, b: Column, shapes: tuple[Column, Column] | None = None) -> Column:
    """Products of elements; ``shapes`` as in ``add``."""
    return F.zip_with(_same(a, b, shapes), b, lambda x, y: x * y)


def add_scalar(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x + F.lit(k))


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(k))


def crop(pixels: Column, width: Column, height: Column, bands: Column, x: int, y: int, w: int, h: int) -> Column:
    """The window of w x h pixels at (x, y); outside of the image it is an error."""
    rows = F.transform(F.sequence(F.lit(y), F.lit(y + h - 1)), lambda j: F.slice(pixels, (j * width + x) * bands + 1, bands * w))
    inside = (F.lit(x + w) <= width) & (F.lit(y + h) <= height) & F.lit(x >= 0 and y >= 0 and w > 0 and h > 0)
    return F.when(inside, F.flatten(rows)).otherwise(F.raise_error(F.lit("crop outside of the image")))


def equals(a: Column, b: Column, tolerance: float = 0.0, shapes: tuple[Column, Column] | None = None) -> Column:
    """True where numbers of elements (and ``shapes``, if given) agree and no element differs by more than ``tolerance``."""
    near = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= tolerance)
    return near & (shapes[0] == shapes[1]) if shapes else near


def psnr(a: Column, b: Column, peak: float = 255.0) -> Column:
    """Peak signal-to-noise ratio in dB; null where the arrays are equal."""
    squares = F.zip_with(_same(a, b, None), b, lambda x, y: (x - y) * (x - y))
    mse = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse))


def blank(n: Column) -> Column:
    """Storage of n zeros; a negative size is an error."""
    return F.when(n >= 0, F.array_repeat(F.lit(0.0), n)).otherwise(F.raise_error(F.lit("negative size")))


#: Element kinds of typed arrays, the high byte first.
_TYPED = {"short": ">i2", "int": ">i4", "float": ">f4", "double": ">f8"}


def array_to_bytes(values: Column, kind: str) -> Column:
    """The bytes of an array of ``short``, ``int``, ``float`` or ``double``, the high byte of each first."""
    layout = _TYPED[kind]

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x).astype(layout).tobytes() for x in v], dtype=object)

    return run(values)


def bytes_to_array(data: Column, kind: str) -> Column:
    """The array that ``array_to_bytes`` gave the bytes of; a length that isn't whole elements is an error."""
    layout = _TYPED[kind]

    @F.pandas_udf(f"array<{kind}>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(x, layout).astype(layout[1:]) for x in v], dtype=object)

    return run(data)


def to_matrix(pixels: Column, pixel_type: int) -> Column:
    """An image as a matrix (type, rows, cols, data); no pixels, sizes below 1 or other than 1 to 4 bands are an error."""
    sound = pixels.isNotNull() & (F.col("width") > 0) & (F.col("height") > 0) & F.col("bands").between(1, 4)
    made = F.struct(matrix_type(F.lit(pixel_type), F.col("bands")).cast("int").alias("type"), F.col("height").alias("rows"), F.col("width").alias("cols"), pixels.alias("data"))
    return F.when(sound, made).otherwise(F.raise_error(F.lit("this image can't be a matrix")))


def type_size(t: Column) -> Column:
    return F.when(t == 0, 1).when(t.isin(1, 2), 2).when(t.isin(3, 4), 4).when(t == 5, 8).otherwise(F.raise_error(F.lit("unknown pixel type")))


def matrix_type(t: Column, bands: Column) -> Column:
    """Matrix type code of a pixel type and 1 to 4 bands, else -1: the depth plus 8 for each further band."""
    depth = F.when(t == 0, 0).when(t == 1, 2).when(t == 2, 3).when(t == 3, 4).when(t == 4, 5).when(t == 5, 6)
    return F.when(bands.between(1, 4) & depth.isNotNull(), depth + 8 * (bands - 1)).otherwise(-1)
