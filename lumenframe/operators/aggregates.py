"""Image-level aggregates: average colour, mean patch, covariance, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of a side of a patch, patches of a side of the grid, spread of the weights.
PATCH, GRID, SIGMA = 64, 10, 10.0


def cull(images: DataFrame, dropped: Column) -> DataFrame:
    """``images`` without those for which ``dropped`` is true; null keeps. Put it before any decoding: it reaches the scan."""
    return images.filter(~F.coalesce(dropped, F.lit(False)))


def model_culler(model: str = "Canon PowerShot S500", least: int = 1024) -> Column:
    """True for images to drop: those of other cameras, or below ``least`` pixels on a side; needs the map ``exif``."""
    return ~((F.coalesce(F.col("exif")["Model"], F.lit("")) == model) & (F.col("width") >= least) & (F.col("height") >= least))


def average_color(pixels: DataFrame, image: str = "image_index", bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The unweighted mean over images of each image's mean, and the number of images."""
    means = pixels.groupBy(image).agg(*(F.avg(b).alias(b) for b in bands))
    return means.agg(*(F.avg(b).alias(f"avg_{b}") for b in bands), F.count("*").alias("images"))


def gaussian(n: int = PATCH, sigma: float = SIGMA) -> np.ndarray:
    """Weights of an n x n patch with unit L2 norm, centred on n // 2."""
    d = (np.arange(n) - n // 2) ** 2
    w = np.exp(-(d[:, None] + d[None, :]) / (2 * sigma * sigma))
    return w / np.sqrt((w * w).sum())


def patches(image: np.ndarray, n: int = PATCH, grid: int = GRID) -> np.ndarray:
    """(patch, pixel) of a gray image (y, x); an image smaller than a patch is an error."""
    h, w = image.shape
    if h < n or w < n:
        raise ValueError("the image is smaller than a patch")
    return np.stack([image[(h - n) * j // grid :][:n, (w - n) * i // grid :][:, :n].ravel() for i in range(grid) for j in range(grid)])


def _gray(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for width, height, bands, pixels in zip(*(batch[c].to_pylist() for c in ("width", "height", "bands")), batch["pixels"]):
        x = np.asarray(pixels.values, np.float64).reshape(height, width, bands)
        yield x[:, :, 0] if bands == 1 else x @ np.array([0.299, 0.587, 0.114])


def _usable(images: DataFrame) -> DataFrame:
    return images.filter("pixels is not null and color_space in (1, 2)").select("width", "height", "bands", "pixels")


#: A task adds up so many partitions' images, about, before it passes its matrix on.
FAN_IN = 16


def _summed(images: DataFrame, per_image, rows: int, cols: int) -> DataFrame:
    """(i, row, n): the sum over images of ``per_image(gray)``, a matrix of ``rows`` by ``cols``, row by row as bytes of float64, and the number of images.

    A partition passes one matrix on, as ``rows`` binary rows; these are added up by row number: first FAN_IN partitions' at a time, then all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros((rows, cols)), 0
        for b in batches:
            for g in _gray(b):
                total += per_image(g)
                n += 1
        if n:
            turn = TaskContext.get().partitionId() // FAN_IN
            step = max(1, (1 << 22) // (8 * cols))
            for at in range(0, rows, step):
                part = [x.tobytes() for x in total[at : at + step]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), turn, np.int32)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part, pa.binary()), pa.array(np.full(len(part), n))], ["turn", "i", "row", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n = None, np.zeros(cols), 0
        for b in batches:  # sorted, so one row's sum is held at a time
            out = []
            for turn, at, row, count in zip(*(b[c].to_pylist() for c in ("turn", "i", "row", "n"))):
                if (turn, at) != key:
                    if key is not None:
                        out.append((*key, total.tobytes(), n))
                    key, total, n = (turn, at), np.zeros(cols), 0
                total = total + np.frombuffer(row, np.float64)
                n += count
            if out:
                yield _sums(out)
        if key is not None:
            yield _sums([(*key, total.tobytes(), n)])

    schema = "turn int, i int, row binary, n long"
    parts = _usable(images).mapInArrow(run, schema)
    for keep in (True, False):
        parts = parts.select("turn" if keep else F.lit(0).alias("turn"), "i", "row", "n")
        parts = parts.repartition("turn", "i").sortWithinPartitions("turn", "i").mapInArrow(add, schema)
    return parts.select("i", "row", "n")


def _sums(rows: list[tuple]) -> pa.RecordBatch:
    turn, i, row, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(i, pa.int32()), pa.array(row, pa.binary()), pa.array(n, pa.int64())], ["turn", "i", "row", "n"])


def _cells(rows: DataFrame) -> DataFrame:
    """(i, j, v, n) from binary rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row, n in zip(*(b[c].to_pylist() for c in ("i", "row", "n"))):
                v = np.frombuffer(row, np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v), pa.array(np.full(len(v), n))], ["i", "j", "v", "n"])

    return rows.mapInArrow(run, "i int, j int, v double, n long")


def mean_patch(images: DataFrame, n: int = PATCH, grid: int = GRID) -> DataFrame:
    """(pos, v): the mean over images of the mean of each image's patches."""
    found = _cells(_summed(images, lambda g: patches(g, n, grid).mean(axis=0).reshape(n, n), n, n))
    return found.select((F.col("i") * n + F.col("j")).cast("long").alias("pos"), (F.col("v") / F.col("n")).alias("v"))


def covariance_rows(images: DataFrame, mean: np.ndarray, n: int = PATCH, grid: int = GRID, sigma: float | None = SIGMA) -> DataFrame:
    """(i, row): ``covariance`` a row at a time, as bytes of float64."""
    weights = gaussian(n, sigma).ravel() if sigma else 1.0

    def one(g: np.ndarray) -> np.ndarray:
        p = (patches(g, n, grid) - mean) * weights
        return p.T @ p

    return _summed(images, one, n * n, n * n).select("i", "row")


def covariance(images: DataFrame, mean: np.ndarray, n: int = PATCH, grid: int = GRID, sigma: float | None = SIGMA) -> DataFrame:
    """(i, j, v): the scatter of patches less ``mean`` (n * n values) under Gaussian weights (none if ``sigma`` is None), summed over images.

    Each partition adds its images' products up, so one matrix leaves a partition, not one an image.
    """
    return _cells(covariance_rows(images, mean, n, grid, sigma).withColumn("n", F.lit(0).cast("long"))).select("i", "j", "v")


def principal_components(cov: np.ndarray, k: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors (k, n), each with its largest element above 0."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), abs(vectors).argmax(axis=1)])[:, None]
