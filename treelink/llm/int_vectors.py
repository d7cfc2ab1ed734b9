"""Vectors of whole numbers, packed as bytes, and their exact inner products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Packed:
    """rows: the asked columns and code (binary); each code holds dims numbers of type kind."""

    rows: DataFrame
    dims: int
    kind: str


def packed(vectors: DataFrame, embedding: Column, scale: int, **keep: Column) -> Packed | None:
    """floor(scale * x) of every component x as bytes of the narrowest type that holds all rows'; None without a usable row.

    Vectors that are null, empty, hold null or non-finite components, or have another number of dimensions than most take no part.
    Numbers beyond 64 bits stay at the end of their range.
    """
    e = embedding.cast("array<double>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(*[c.alias(n) for n, c in keep.items()], e.alias("e")).filter("size(e) > 0").filter(~F.coalesce(bad, F.lit(False)))
    v = v.withColumn("ints", F.transform("e", lambda x: F.floor(x * float(scale)))).drop("e")
    sizes = v.groupBy(F.size("ints").alias("n")).agg(F.count("*").alias("rows"), F.min(F.array_min("ints")).alias("low"), F.max(F.array_max("ints")).alias("high"))
    usual = sizes.orderBy(F.desc("rows"), "n").first()
    if usual is None:
        return None
    dims, names = usual["n"], list(keep)
    kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= usual["low"] and usual["high"] <= np.iinfo(k).max)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = np.asarray(b.column("ints").flatten()).reshape(-1, dims).astype(kind)
            yield pa.record_batch([*[b.column(n) for n in names], to_binary(numbers)], names=[*names, "code"])

    types = dict(v.dtypes)
    made = v.filter(F.size("ints") == dims).mapInArrow(pack, ", ".join(f"{n} {types[n]}" for n in names) + ", code binary")
    return Packed(made, dims, kind)


def to_binary(numbers: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    width = numbers.shape[1] * numbers.itemsize
    at = pa.py_buffer(np.arange(len(numbers) + 1, dtype=np.int64) * width)
    return pa.Array.from_buffers(pa.large_binary(), len(numbers), [None, at, pa.py_buffer(np.ascontiguousarray(numbers).tobytes())]).cast(pa.binary())


def to_numbers(code: pa.Array | pa.ChunkedArray, kind: str, dims: int) -> np.ndarray:
    """The inverse of to_binary."""
    return np.frombuffer(b"".join(code.to_pylist()), kind).reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b as int64: by floating-point matrices while these are exact, else by whole numbers, which wrap beyond 64 bits."""
    size = [float(np.abs(m.astype(np.float64)).max(initial=0.0)) for m in (a, b)]
    if size[0] * size[1] * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a.astype(np.int64) @ b.astype(np.int64).T
