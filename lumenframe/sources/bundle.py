"""Image bundles as a Spark data source, ``imagebundle``: read and written in parallel, split at image boundaries.

A bundle is two files: an index with the end of each record, and the records in ``<index>.dat``. A path may be one bundle or a
folder of them, as the writer leaves it: one for each task. Files are opened by path, so it must be one that all executors see.
"""

from __future__ import annotations

import json
import operator
import os
import re
import shutil
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import RAW

MAGIC = 0x81911B18
_INDEX, _SIGNATURE, _HEADER = struct.Struct(">IqqI"), struct.Struct(">iii"), struct.Struct(">iiiiii")


def offsets(path: str, most: int = 0) -> np.ndarray:
    """Ends of the records, of the first ``most`` (0: all); the file is mapped, so only what is looked at is read."""
    with open(path, "rb") as f:
        head = f.read(_INDEX.size)
    if len(head) < _INDEX.size or _INDEX.unpack(head)[0] != MAGIC:
        raise ValueError(f"{path} is no bundle's index")
    at = _INDEX.size + _INDEX.unpack(head)[3]
    n = (os.path.getsize(path) - at) // 8
    n = min(n, most) if most else n
    return np.memmap(path, ">i8", "r", at, n) if n else np.zeros(0, np.int64)


def bundles(path: str) -> list[str]:
    if not os.path.isdir(path):
        return [path]
    return [os.path.join(path, x) for x in sorted(os.listdir(path)) if os.path.exists(os.path.join(path, f"{x}.dat"))]


@dataclass
class Records(InputPartition):
    path: str
    start: int
    end: int
    first: int


#: Comparisons of a header column with a number, as the option ``where`` has them.
_TESTS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_FIELDS = ("image_index", "storage_format", "color_space", "width", "height", "bands")
#: Rows and bytes of payload of a batch, about.
_ROWS, _BYTES = 1024, 16 << 20


class BundleReader(DataSourceReader):
    """Options: ``splitBytes`` or ``numPartitions``; ``start`` and ``end``, offsets in the records' file, of which the records that begin at
    ``start`` or later and before ``end`` or at it are read (0: to the end); ``payload`` ``false``, which leaves payloads null and unread;
    ``where``, comparisons of header columns with numbers, such as ``width > 3200 and storage_format = 1``, that are made before a payload
    is read. An option rather than pushed filters: Spark keeps a reader with the filters of one query for other queries of the same DataFrame.
    """

    def __init__(self, path: str, options: dict):
        self.path, self.wanted, self.index = path, int(options.get("numPartitions", 0)), None
        self.size = int(options.get("splitBytes", 128 << 20))
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 0))
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[int, object, int]] = []
        for part in filter(None, re.split(r"\s+and\s+", options.get("where", "").strip(), flags=re.IGNORECASE)):
            m = re.fullmatch(r"(\w+)\s*(=|>=|<=|>|<)\s*(-?\d+)", part.strip())
            if not m or m[1] not in _FIELDS:
                raise ValueError(f"where can't read {part}")
            self.tests.append((_FIELDS.index(m[1]), _TESTS[m[2]], int(m[3])))
            if m[1] == "image_index" and m[2] == "=":
                self.index = int(m[3])

    def partitions(self) -> list[Records]:
        """Records that begin in one span of ``splitBytes``, or, with ``numPartitions``, the images left over the splits left, rounded up."""
        found, first = [], 0
        for path in bundles(self.path):
            ends = offsets(path)
            n = len(ends)
            begin = lambda i: int(ends[i - 1]) if i else 0  # noqa: B023, E731
            lo = int(np.searchsorted(ends, self.start, "left")) + 1 if self.start else 0
            hi = min(n, int(np.searchsorted(ends, self.end, "right")) + 1) if self.end else n
            if self.index is not None:
                if lo <= (k := self.index - first) < hi:
                    found.append(Records(path, begin(k), int(ends[k]), self.index))
            else:
                at, left = lo, self.wanted
                while at < hi:
                    if self.wanted:
                        to, left = at + -(-(hi - at) // max(1, left)), left - 1
                    else:
                        past = (begin(at) // self.size + 1) * self.size  # the next span's first byte
                        to = min(hi, max(at + 1, int(np.searchsorted(ends, past, "left")) + 1))
                    found.append(Records(path, begin(at), int(ends[to - 1]), first + at))
                    at = to
            first += n
        return found or [Records("", 0, 0, 0)]

    def read(self, p: Records) -> Iterator[pa.RecordBatch]:
        if not p.path:
            return
        rows, held = [], 0
        with open(f"{p.path}.dat", "rb") as f:
            f.seek(p.start)
            index = p.first
            while f.tell() < p.end:
                signature = f.read(_SIGNATURE.size)
                n, size, kind = _SIGNATURE.unpack(signature) if len(signature) == _SIGNATURE.size else (0, 0, 0)
                if n <= 0 or size <= 0 or not kind:
                    raise ValueError(f"{p.path}.dat holds a damaged record before {f.tell()}")
                head = f.read(n)
                fmt, space, w, h, bands, length = _HEADER.unpack_from(head)
                fields = (index, fmt, space, w, h, bands)
                index += 1
                if all(test(fields[i], value) for i, test, value in self.tests):
                    meta = json.loads(head[_HEADER.size : _HEADER.size + length] or b"{}")
                    rows.append((*fields, list(meta.items()), f.read(size) if self.payload else f.seek(size, 1) and None))
                    held += size if self.payload else 0
                    if len(rows) >= _ROWS or held >= _BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                else:
                    f.seek(size, 1)
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([("image_index", pa.int64()), *((n, pa.int32()) for n in _FIELDS[1:]), ("meta", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


@dataclass
class Part(WriterCommitMessage):
    path: str
    images: int


class BundleWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        if os.path.exists(path):
            if not overwrite:
                raise ValueError(f"{path} exists")
            shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        os.makedirs(path)

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{self.path}/_part-{context.partitionId():05d}-{context.attemptNumber()}"
        end, n = 0, 0
        with open(name, "wb") as index, open(f"{name}.dat", "wb") as data:
            index.write(_INDEX.pack(MAGIC, 0, 0, 0))
            for r in rows:
                meta = json.dumps(r["meta"] or {}).encode()
                head = _HEADER.pack(r["storage_format"], r["color_space"], r["width"], r["height"], r["bands"], len(meta)) + meta
                data.write(_SIGNATURE.pack(len(head), len(r["payload"]), r["storage_format"]) + head + r["payload"])
                end += _SIGNATURE.size + len(head) + len(r["payload"])
                index.write(struct.pack(">q", end))
                n += 1
        return Part(name, n)

    def commit(self, parts: list[Part]) -> None:
        """Names the parts of the tasks that count; what other attempts left is removed."""
        for p in parts:
            if p and p.images:
                final = os.path.join(self.path, os.path.basename(p.path)[1:].rpartition("-")[0])
                os.replace(p.path, final)
                os.replace(f"{p.path}.dat", f"{final}.dat")
        for x in os.listdir(self.path):
            if x.startswith("_part-"):
                os.remove(os.path.join(self.path, x))

    def abort(self, parts: list[Part]) -> None:
        shutil.rmtree(self.path, True)


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imagebundle"

    def schema(self) -> StructType:
        return RAW

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(self.options["path"], self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``imagebundle`` known."""
    spark.dataSource.register(BundleSource)
