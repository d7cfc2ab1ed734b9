"""Readers, writers and generators of edge tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import draw
from ..operators.graph import draws_for, gather_features, node_map, remap, temporal_pairs, test_degree, valid_stub
from ..operators.order import smallest
from ..scratch import Scratch


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Edges from the first two tokens of each line, separated by blanks or tabs."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return spark.read.text(path).filter(F.size(parts) >= 2).select(parts[0].cast("bigint").alias("src"), parts[1].cast("bigint").alias("dst"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edges from the columns source and target of a CSV with a header."""
    return spark.read.csv(path, header=True).select(F.col("source").cast("bigint").alias("src"), F.col("target").cast("bigint").alias("dst"))


def write_text(edges: DataFrame, path: str, weighted: bool = False) -> None:
    """Tab-separated pairs, or pairs with weight 1 separated by blanks."""
    if weighted:
        edges.select(F.concat_ws(" ", "src", "dst", F.lit(1)).alias("value")).write.mode("overwrite").text(path)
    else:
        edges.select("src", "dst").write.mode("overwrite").csv(path, sep="\t")


def read_labelled(spark: SparkSession, pos: str, neg: str) -> DataFrame:
    """src, dst, label: positives of one text and negatives of another."""
    one = lambda path, label: read_text(spark, path).withColumn("label", F.lit(label))
    return one(pos, 1).unionByName(one(neg, 0))


def read_temporal(spark: SparkSession, paths: list[str]) -> DataFrame:
    """sub, rel, obj, t: facts of several text files (train, valid and test parts), four whole numbers a line."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(paths).filter(F.size(parts) >= 4)
    return lines.select(*[parts[i].cast("bigint").alias(c) for i, c in enumerate(("sub", "rel", "obj", "t"))])


def timed_edges(facts: DataFrame, how: str) -> DataFrame:
    """src, dst, t: one time per ordered pair of subject and object."""
    return temporal_pairs(facts.select(F.col("sub").alias("src"), F.col("obj").alias("dst"), "t"), how)


def read_npy(spark: SparkSession, path: str, rows_per_range: int = 1 << 20) -> DataFrame:
    """src, dst of a NumPy file of whole numbers, shaped (2, edges) or (edges, 2). Tasks read ranges of it; only its header is read here.

    Opened with pyarrow's file systems. Fortran order and other types raise.
    """

    def opened():
        fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        return fs.open_input_file(inner)

    with opened() as f:
        head = io.BytesIO(f.read_at(min(4096, f.size()), 0))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran or dtype.kind not in "iu" or len(shape) != 2 or 2 not in shape:
        raise ValueError(f"(2, edges) or (edges, 2) whole numbers, not {shape} of {dtype}")
    start, n, wide = head.tell(), shape[1] if shape[0] == 2 else shape[0], shape[0] == 2

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened() as f:
            part = lambda at, count: np.frombuffer(f.read_at(count * dtype.itemsize, start + at * dtype.itemsize), dtype).astype(np.int64)
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    a, m = i * rows_per_range, min(rows_per_range, n - i * rows_per_range)
                    src, dst = (part(a, m), part(n + a, m)) if wide else part(2 * a, 2 * m).reshape(-1, 2).T
                    yield pa.record_batch({"src": pa.array(src), "dst": pa.array(dst)})

    return spark.range(-(-n // rows_per_range)).mapInArrow(ranges, "src long, dst long")


def write_bundle(train: DataFrame, test_pos: DataFrame, test_neg: DataFrame, path: str, features: DataFrame | None = None) -> None:
    """A split with compacted ids as Parquet tables in one folder.

    edges (part: train, test_pos, test_neg or valid, the latter a stub), node_map (node, idx), test_degree (node, test_degree) and, if
    given, features (idx, ...). Ids beyond train become -1.
    """
    ids = Scratch(train.sparkSession, "bundle").save(node_map(train), "ids")
    parts = {"train": train, "test_pos": test_pos, "test_neg": test_neg, "valid": valid_stub(train)}
    mapped = [remap(d.select("src", "dst"), ids).withColumn("part", F.lit(name)) for name, d in parts.items()]
    edges = mapped[0]
    for d in mapped[1:]:
        edges = edges.unionByName(d)
    edges.write.mode("overwrite").partitionBy("part").parquet(f"{path}/edges")
    ids.write.mode("overwrite").parquet(f"{path}/node_map")
    test_degree(ids.select(F.col("idx").alias("node")), mapped[1]).write.mode("overwrite").parquet(f"{path}/test_degree")
    if features is not None:
        gather_features(ids, features).write.mode("overwrite").parquet(f"{path}/features")


def read_bundle(spark: SparkSession, path: str, part: str) -> DataFrame:
    """src, dst of one part; only its files are read."""
    return spark.read.parquet(f"{path}/edges").filter(F.col("part") == part).select("src", "dst")


def random_graph(spark: SparkSession, n: int, edges: int, seed: int = 42, is_directed: bool = True) -> DataFrame:
    """About `edges` distinct uniform pairs of n nodes without loops, from counters."""
    e = spark.range(edges).select((draw(seed, "u", F.col("id")) % n).alias("a"), (draw(seed, "v", F.col("id")) % n).alias("b")).filter("a <> b")
    if is_directed:
        return e.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def gnp_edges(n: int, p: float, seed: int, is_directed: bool) -> int:
    """Number of edges of a graph in which each of the possible pairs without loops is an edge with probability p."""
    return int(np.random.default_rng(seed).binomial(n * (n - 1) // (1 if is_directed else 2), p))


def gnp_graph(spark: SparkSession, n: int, p: float, seed: int = 42, is_directed: bool = True) -> DataFrame:
    """G(n, p): a binomial number of distinct uniform pairs without loops. Work grows with edges, not with pairs."""
    return exact_graph(spark, n, gnp_edges(n, p, seed, is_directed), seed, is_directed)


def exact_graph(spark: SparkSession, n: int, want: int, seed: int = 42, is_directed: bool = True) -> DataFrame:
    """G(n, m): want distinct uniform pairs of n nodes without loops, the first that counters draw."""
    pairs = n * (n - 1) // (1 if is_directed else 2)
    if want > pairs:
        raise ValueError(f"{n} nodes have fewer than {want} pairs")
    scratch = Scratch(spark, "gnp")
    draws = draws_for(want, pairs, n * n / (1 if is_directed else 2)) if want else 1
    while True:
        e = spark.range(draws).select("id", (draw(seed, "u", F.col("id")) % n).alias("a"), (draw(seed, "v", F.col("id")) % n).alias("b")).filter("a <> b")
        src, dst = (F.col("a"), F.col("b")) if is_directed else (F.least("a", "b"), F.greatest("a", "b"))
        found = scratch.save(e.select("id", src.alias("src"), dst.alias("dst")).groupBy("src", "dst").agg(F.min("id").alias("id")), str(draws))
        if found.count() >= want:
            return smallest(found, "id", want).select("src", "dst")
        draws *= 2
