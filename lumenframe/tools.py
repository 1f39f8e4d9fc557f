"""End-user operations: import, merge, info, dump, export, download, mean patch and covariance, and what shows these."""

from __future__ import annotations

import gzip
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import jpeg, matrix, netpbm, png
from .functions.text import dump_line
from .operators.aggregates import GRID, PATCH, SIGMA, covariance_rows, mean_patch, principal_components
from .schema import HEADER, RAW, valid
from .sources import bundle, files


def import_images(spark: SparkSession, folder: str, out: str, overwrite: bool = False) -> None:
    """Image files of ``folder``, in the order of their paths, as a bundle.

    Only paths are numbered; payloads are read once, by the tasks that write them.
    """
    bundle.register(spark)
    rows = files.images(spark, folder).repartitionByRange("path").sortWithinPartitions("path")
    rows.withColumn("image_index", F.lit(0).cast("long")).select(*RAW.fieldNames()).write.format("imagebundle").mode("overwrite" if overwrite else "append").save(out)


def merge(spark: SparkSession, out: str, *paths: str, overwrite: bool = False, remove: bool = False) -> list[str]:
    """The bundles at ``paths``, one after the other, as one; with ``remove`` these are deleted. Gives the bundles written."""
    rows = load(spark, *paths)
    rows.write.format("imagebundle").mode("overwrite" if overwrite else "append").save(out)
    if remove:
        for p in paths:
            for x in (p, f"{p}.dat"):
                shutil.rmtree(x) if os.path.isdir(x) else os.path.exists(x) and os.remove(x)
    return bundle.bundles(out)


def load(spark: SparkSession, *paths: str, **options: str) -> DataFrame:
    """The images of all bundles at ``paths``, numbered within each path; ``options`` are those of ``BundleReader``.

    ``where="image_index = 7"`` reads one image by the index; ``payload="false"`` reads headers only.
    """
    bundle.register(spark)
    found = [spark.read.format("imagebundle").options(**options).load(p) for p in paths]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def info(images: DataFrame, index: int | None = None, meta_key: str | None = None, exif_key: str | None = None) -> DataFrame:
    """Headers of all images, or of one; with ``meta_key`` that value of each, with ``exif_key`` that EXIF tag."""
    rows = images if index is None else images.filter(F.col("image_index") == index)
    if meta_key:
        return rows.select("image_index", F.col("meta")[meta_key].alias(meta_key))
    if exif_key:
        return rows.select("image_index", files.exif("payload", "storage_format")[exif_key].alias(exif_key))
    return rows.select(*HEADER.fieldNames())


def with_exif(images: DataFrame) -> DataFrame:
    """``images`` with their EXIF tags as a map ``exif``, which a cull can look at."""
    return images.withColumn("exif", files.exif("payload", "storage_format"))


def dump(images: DataFrame) -> DataFrame:
    """A line for each image: size, source and the camera's model; ``images`` have payloads, or a map ``exif``."""
    rows = images if "exif" in images.columns else with_exif(images)
    return rows.select("image_index", dump_line(F.col("meta")["source"], F.col("exif")["Model"]).alias("line"))


def write_dump(images: DataFrame, out: str) -> None:
    """The lines of ``dump`` as one text file in the folder ``out``, each after the key 1, as one reducer writes them.

    Lines are few bytes an image; they are sorted by index as they are written.
    """
    lines = dump(images).select(F.concat(F.lit("1\t"), "line").alias("value"), "image_index")
    lines.coalesce(1).sortWithinPartitions("image_index").select("value").write.text(out)


def by_format(images: DataFrame) -> DataFrame:
    """``images`` in the order of their storage formats, and in these by index."""
    return images.orderBy("storage_format", "image_index")


_ENCODERS = {"png": png.encode, "ppm": netpbm.encode, "jpg": jpeg.encode, "jpeg": jpeg.encode}


def extract(images: DataFrame, index: int, path: str) -> None:
    """One image as a file, encoded by the suffix of its name (jpg, png or ppm)."""
    encode = _ENCODERS.get(path.rpartition(".")[2].lower())
    if not encode:
        raise ValueError(f"no encoder for {path}")
    row = images.filter(F.col("image_index") == index).select("payload", "storage_format").first()
    if row is None:
        raise IndexError(index)
    pixels = files.pixels_of(row["payload"], row["storage_format"])
    if pixels is None:
        raise ValueError(f"image {index} can't be decoded")
    with open(path, "wb") as f:
        f.write(encode(pixels))


def to_jpeg(images: DataFrame, out: str) -> DataFrame:
    """Writes every image as ``<base name of its source>.jpg`` in the folder ``out``, which all executors see; (``written``, ``name``) of each.

    Images that can't be decoded or have no source are left out. Each task writes its own images as the result is read, each file under
    another name first, so that a task that is run again does no harm.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(out, exist_ok=True)
        for b in batches:
            names = []
            for payload, kind, source in zip(*(b[c].to_pylist() for c in ("payload", "storage_format", "source"))):
                name = (source or "").rpartition("/")[2]
                name = name.rpartition(".")[0] or name
                pixels = files.pixels_of(payload, kind) if name else None
                if pixels is None:
                    continue
                draft = os.path.join(out, f".{name}-{uuid.uuid4().hex}")
                with open(draft, "wb") as f:
                    f.write(jpeg.encode(pixels))
                os.replace(draft, os.path.join(out, f"{name}.jpg"))
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(names)), pa.array(names, pa.string())], ["written", "name"])

    return images.filter(valid()).select("payload", "storage_format", F.col("meta")["source"].alias("source")).mapInArrow(run, "written boolean, name string")


def write_pairs(rows: DataFrame, out: str, compressed: bool = True) -> int:
    """The bytes of each row's ``key`` and then ``value`` (binary; null is left out), one file a task in the folder ``out``; gives the number of files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(out, exist_ok=True)
        name = os.path.join(out, f"part-{TaskContext.get().partitionId():05d}" + (".gz" if compressed else ""))
        draft = os.path.join(out, f".{uuid.uuid4().hex}")
        with (gzip.open if compressed else open)(draft, "wb") as f:
            for b in batches:
                for k, v in zip(b["key"].to_pylist(), b["value"].to_pylist()):
                    f.write((k or b"") + (v or b""))
        os.replace(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return rows.select("key", "value").mapInArrow(run, "name string").count()


#: URLs that are fetched before their images are passed on, so that no more are held.
FETCHED = 100


def download(urls: DataFrame, fetch: Callable[[str], tuple[str, bytes]], nodes: int = 10) -> DataFrame:
    """Headers and payloads of what ``fetch`` (url -> content type, bytes) gives for JPEG and PNG; what fails is left out.

    ``urls`` has ``url``, or is a photo list (``files.photo_list``), whose ``download_url`` is fetched and whose columns are kept as metadata.
    Images are passed on FETCHED at a time.
    """
    listed = "download_url" in urls.columns and "url" not in urls.columns
    asked = urls.select(F.col("download_url").alias("url"), "meta") if listed else urls.select("url", F.create_map().cast("map<string,string>").alias("meta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), FETCHED):
                part, rows = b.slice(at, FETCHED), []
                for i, url in enumerate(part["url"].to_pylist()):
                    try:
                        kind, data = fetch(url)
                    except OSError:
                        continue
                    if kind in ("image/jpeg", "image/png"):
                        rows.append((i, 1 if kind == "image/jpeg" else 2, data))
                own = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["url"].take(own), part["meta"].take(own), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["url", "meta", "storage_format", "payload"]
                )

    got = asked.repartition(nodes).mapInArrow(run, "url string, meta map<string,string>, storage_format int, payload binary")
    found = got.withColumn("head", files.read_header("payload", "storage_format")).filter("head.width is not null")
    meta = F.map_concat(F.create_map(F.lit("source"), "url"), "meta")
    return found.select("storage_format", F.lit(1).alias("color_space"), "head.*", meta.alias("meta"), "payload")


def download_to(spark: SparkSession, urls: DataFrame, fetch: Callable[[str], tuple[str, bytes]], out: str, nodes: int = 10, overwrite: bool = False) -> int:
    """Downloads into a bundle, a file for each of ``nodes`` tasks; gives the number of images."""
    bundle.register(spark)
    rows = download(urls, fetch, nodes).withColumn("image_index", F.lit(0).cast("long")).select(*RAW.fieldNames())
    rows.write.format("imagebundle").mode("overwrite" if overwrite else "append").save(out)
    return sum(len(bundle.offsets(b)) for b in bundle.bundles(out))


def covariance_files(images: DataFrame, out: str, n: int = PATCH, grid: int = GRID, sigma: float | None = SIGMA) -> None:
    """The mean patch and the covariance of decoded ``images`` as the matrix files ``mean`` and ``covariance`` in the folder ``out``."""
    mean = np.zeros(n * n)
    for r in mean_patch(images, n, grid).collect():  # n * n numbers, however many images
        mean[r["pos"]] = r["v"]
    found = np.zeros((n * n, n * n), np.float32)
    for r in covariance_rows(images, mean, n, grid, sigma).toLocalIterator():  # a row of the matrix at a time
        found[r["i"]] = np.frombuffer(r["row"], np.float64)
    os.makedirs(out, exist_ok=True)
    for name, m in (("mean", mean.reshape(n, n).astype(np.float32)), ("covariance", found)):
        with open(os.path.join(out, name), "wb") as f:
            f.write(matrix.encode(m))


def _shown(values: np.ndarray) -> np.ndarray:
    """Gray pixels of three bands from numbers, the least black and the greatest white; equal numbers are black."""
    low, high = float(values.min()), float(values.max())
    gray = np.rint((values - low) * (255 / (high - low) if high > low else 0)).astype(np.uint8)
    return np.repeat(gray[:, :, None], 3, axis=2)


def show_mean(path: str, out: str) -> None:
    """The mean patch in the matrix file ``path`` as a PNG."""
    with open(path, "rb") as f, open(out, "wb") as g:
        g.write(png.encode(_shown(matrix.decode(f.read()))))


def show_components(path: str, out: str, k: int = 15, across: int = 5) -> None:
    """The ``k`` principal components of the covariance in the matrix file ``path`` as one PNG, ``across`` patches a row, each in its own range."""
    with open(path, "rb") as f:
        cov = matrix.decode(f.read()).astype(np.float64)
    side = int(round(len(cov) ** 0.5))
    if side * side != len(cov):
        raise ValueError(f"{path} is no covariance of square patches")
    _, vectors = principal_components(cov, k)
    sheet = np.zeros((-(-len(vectors) // across) * side, across * side, 3), np.uint8)
    for i, v in enumerate(vectors):
        y, x = i // across * side, i % across * side
        sheet[y : y + side, x : x + side] = _shown(v.reshape(side, side))
    with open(out, "wb") as f:
        f.write(png.encode(sheet))
