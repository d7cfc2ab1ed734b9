"""Formats for spark.read: `edge_npy` (NumPy arrays of edges) and `temporal_facts` (text facts with times), with partitions and filters of their own.

register_formats() makes them known to a session and turns `spark.sql.python.filterPushdown.enabled` on, without which Spark refuses
readers that take filters: comparisons of columns with numbers are applied in the tasks that read, before rows go to the JVM. Files
are opened with pyarrow's file systems.
"""

from __future__ import annotations

import io
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

#: Filters that readers apply themselves, by their class.
COMPARED = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def file_of(path: str) -> pa.NativeFile:
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs.open_input_file(inner)


@dataclass
class Range(ds.InputPartition):
    """Rows, or bytes, of one file."""

    path: str
    start: int
    stop: int


class RangeReader(ds.DataSourceReader):
    """Partitions of equal size and pushed comparisons; columns come as arrays of whole numbers."""

    columns: tuple[str, ...]

    def __init__(self, options: dict[str, str], size: int):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.size = int(options.get("size", size))
        self.tests: list[tuple[str, type, int]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and f.attribute[0] in self.columns and isinstance(f.value, int):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def length(self, path: str) -> int:
        raise NotImplementedError

    def arrays(self, part: Range) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def partitions(self) -> list[Range]:
        return [Range(p, i, min(i + self.size, n)) for p in self.paths for n in [self.length(p)] for i in range(0, n, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        found = self.arrays(partition)
        for name, test, value in self.tests:
            keep = COMPARED[test](found[name], value)
            found = {c: v[keep] for c, v in found.items()}
        yield pa.record_batch({c: pa.array(found[c].astype(np.int64)) for c in self.columns})


class NpyReader(RangeReader):
    columns = ("src", "dst")

    def header(self, f: pa.NativeFile) -> tuple[int, int, np.dtype, bool]:
        """Where the numbers start, how many edges there are, their type, and whether all sources come before all targets."""
        head = f.read_at(min(12, f.size()), 0)
        wide = 2 if head[6] == 1 else 4
        size = 8 + wide + int.from_bytes(head[8 : 8 + wide], "little")
        read = np.lib.format.read_array_header_1_0 if wide == 2 else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(io.BytesIO(f.read_at(size - 8, 8)))
        if fortran or dtype.kind not in "iu" or len(shape) != 2 or 2 not in shape:
            raise ValueError(f"(2, edges) or (edges, 2) whole numbers, not {shape} of {dtype}")
        return size, shape[1] if shape[0] == 2 else shape[0], dtype, shape[0] == 2

    def length(self, path: str) -> int:
        with file_of(path) as f:
            return self.header(f)[1]

    def arrays(self, part: Range) -> dict[str, np.ndarray]:
        with file_of(part.path) as f:
            start, n, dtype, wide = self.header(f)
            m = part.stop - part.start
            some = lambda at, count: np.frombuffer(f.read_at(count * dtype.itemsize, start + at * dtype.itemsize), dtype)
            src, dst = (some(part.start, m), some(n + part.start, m)) if wide else some(2 * part.start, 2 * m).reshape(-1, 2).T
        return {"src": src, "dst": dst}


class FactsReader(RangeReader):
    columns = ("sub", "rel", "obj", "t")

    def length(self, path: str) -> int:
        with file_of(path) as f:
            return f.size()

    def arrays(self, part: Range) -> dict[str, np.ndarray]:
        """Lines that begin in the range, the last one read to its end."""
        with file_of(part.path) as f:
            at = part.start
            text = f.read_at(part.stop - at + 1, at - 1) if at else b"\n" + f.read_at(part.stop, 0)
            stop = part.stop
            while not text.endswith(b"\n") and stop < f.size():
                more = f.read_at(min(1 << 16, f.size() - stop), stop)
                cut = more.find(b"\n") + 1
                text, stop = text + (more[:cut] if cut else more), stop + (cut or len(more))
        lines = text[text.find(b"\n") + 1 :].split(b"\n") if b"\n" in text else []
        rows = [x[:4] for x in (line.split() for line in lines) if len(x) >= 4]
        numbers = np.array(rows, dtype=np.int64) if rows else np.zeros((0, 4), np.int64)
        return dict(zip(self.columns, numbers.T, strict=True))


class EdgeNpy(ds.DataSource):
    """Options: path, or paths (separated by commas); size: edges a partition."""

    @classmethod
    def name(cls) -> str:
        return "edge_npy"

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema) -> ds.DataSourceReader:
        return NpyReader(self.options, 1 << 20)


class TemporalFacts(ds.DataSource):
    """Options: path, or paths (separated by commas; train, valid and test parts are one table); size: bytes a partition."""

    @classmethod
    def name(cls) -> str:
        return "temporal_facts"

    def schema(self) -> str:
        return "sub bigint, rel bigint, obj bigint, t bigint"

    def reader(self, schema) -> ds.DataSourceReader:
        return FactsReader(self.options, 1 << 25)


def register_formats(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EdgeNpy, TemporalFacts):
        spark.dataSource.register(source)
    return spark
