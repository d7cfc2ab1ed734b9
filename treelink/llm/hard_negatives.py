"""Hard negatives by a two-dimensional block product of anchors and rows (SUMMA): shards of rows and of dimensions, sums of score tiles.

Anchors and rows are dealt into blocks of at most about `anchor_block` and `row_block`; a block's vectors are cut into `chunks` runs of
dimensions. The task of (anchor block, row block, chunk) multiplies two shards; partial tiles of 64-bit scores, packed to the width they
need, are shuffled to their tile, added there, and only the best rows of each anchor leave it. Blocks hold labels of one bucket, so
positives come from tiles of equal buckets and negatives from the other tiles, and no tile is made twice where a bucket is one label.
First the positives of every anchor are found, then each tile looks for the best rows in the score window of each anchor and positive.

Work and shuffle grow with anchors times rows, which the method implies; memory of a task is a tile.

Defined results: rows with a null id or label, and vectors that are null, empty, hold null or non-finite components, or have another
number of dimensions than most take no part. Equal scores go by smaller vec_id, then by place; rows are told apart by their place, so
repeated ids are rows each. Anchors without positives and pairs without negatives give no rows, nor does an empty table. Other columns
are ignored, whatever their names. Scores are 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .int_vectors import packed, products, to_numbers

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Labels are dealt to so many buckets; blocks don't mix them.
BUCKETS = 256
SHARD = "block int, bucket int, chunk int, n int, part binary, ids binary"


def to_tile(scores: np.ndarray) -> tuple[int, str, bytes]:
    """A tile as its least score, and what exceeds it in the narrowest type."""
    low, high = int(scores.min()), int(scores.max())
    kind = next((k for k in ("uint8", "uint16", "uint32") if high - low <= np.iinfo(k).max), None)
    if kind is None:
        return 0, "int64", scores.tobytes()
    return low, kind, (scores - low).astype(kind).tobytes()


def from_tile(low: int, kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64) + low


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, largest first; of equal ones those before."""
    near = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, -k)[-k])
    return near[np.argsort(-score[near], kind="stable")][:k]


def _shards(rows: DataFrame, dims: int, kind: str, chunks: int, extra: int = 0) -> DataFrame:
    """The chunks of each block of rows (block, bucket, vec_id, uid, label, code and, for anchors, windows of `extra` scores); the first one brings its rows' numbers."""
    cuts = np.linspace(0, dims, min(chunks, dims) + 1).astype(int)

    def cut(block: pa.Table) -> pa.Table:
        block = block.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        x = to_numbers(block["code"], kind, dims)
        ids = [np.asarray(block[c]) for c in ("vec_id", "uid", "label")]
        if extra:
            ids += list(np.asarray(block["windows"].combine_chunks().flatten()).reshape(-1, extra).T)
        first, n = (block[c][0].as_py() for c in ("block", "bucket")), len(x)
        at, bucket = first
        parts = [np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        numbers = [np.stack(ids).astype(np.int64).tobytes()] + [None] * (len(parts) - 1)
        m = len(parts)
        return pa.table([pa.array([at] * m, pa.int32()), pa.array([bucket] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([n] * m, pa.int32()), pa.array(parts, pa.binary()), pa.array(numbers, pa.binary())], names=["block", "bucket", "chunk", "n", "part", "ids"])

    wanted = ["block", "bucket", "vec_id", "uid", "label", "code", *(["windows"] if extra else [])]
    return rows.select(*wanted).groupBy("block").applyInArrow(cut, SHARD)


def _tiles(anchors: DataFrame, rows: DataFrame, kind: str, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """What pick finds in each summed tile. anchors and rows: shards with the other side's block (a_block, r_block)."""

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["a_block", "r_block", "na", "nb", "low", "kind", "tile", "a_ids", "b_ids"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        na, nb = a["n"][0].as_py(), b["n"][0].as_py()
        x, y = (np.frombuffer(t["part"][0].as_py(), kind).reshape(n, -1) for t, n in ((a, na), (b, nb)))
        row = [a["a_block"][0].as_py(), a["r_block"][0].as_py(), na, nb, *to_tile(products(x, y)), a["ids"][0].as_py(), b["ids"][0].as_py()]
        return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    def reduced(tile: pa.Table) -> pa.Table:
        na, nb, total, ids = tile["na"][0].as_py(), tile["nb"][0].as_py(), None, {}
        for i in range(tile.num_rows):
            part = from_tile(*(tile[c][i].as_py() for c in ("low", "kind", "tile")))
            with np.errstate(over="ignore"):
                total = part if total is None else total + part
            for side, n in (("a_ids", na), ("b_ids", nb)):
                if tile[side][i].is_valid:
                    ids[side] = np.frombuffer(tile[side][i].as_py(), np.int64).reshape(-1, n)
        found = pick(total.reshape(na, nb), ids["a_ids"], ids["b_ids"])
        return pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    keys = ("a_block", "r_block", "chunk")
    partial = anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(multiply, "a_block int, r_block int, na int, nb int, low long, kind string, tile binary, a_ids binary, b_ids binary")
    return partial.groupBy("a_block", "r_block").applyInArrow(reduced, ", ".join(f"{n} long" for n in names))


def _joined(found: list[tuple]) -> list[np.ndarray]:
    """Columns of found pieces."""
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, chunks: int = 2, anchor_block: int = 256, row_block: int = 4096) -> DataFrame:
    """Per anchor and positive the best rows of other labels whose score is between low and high percent of the positive's; see RESULT for columns.

    vectors: vec_id, embedding. Scores are inner products of floor(scale * x). An anchor's positives are the best rows of its own label.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    known = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull())
    made = packed(known, F.col("embedding"), scale, vec_id=F.col("vec_id").cast("long"), label=label.cast("long"), anchor=F.coalesce(is_anchor, F.lit(False)))
    if made is None:
        return spark.createDataFrame([], RESULT)
    dims, kind = made.dims, made.kind
    v = made.rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("bucket", F.pmod("label", F.lit(BUCKETS)).cast("int"))
    v = scratch.save(v, "usable")  # written at once, so a row keeps its number
    per = v.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.col("anchor").cast("long")).alias("anchors"), (F.min("label") == F.max("label")).alias("pure"))
    layout, r_at, a_at = [], 0, 0
    for r in sorted(per.collect()):  # BUCKETS rows at most
        nr, na = -(-r["rows"] // row_block), -(-r["anchors"] // anchor_block)
        layout.append((r["bucket"], r["pure"], r_at, nr, a_at, na))
        r_at, a_at = r_at + nr, a_at + na
    if not a_at:
        return spark.createDataFrame([], RESULT)
    plan = F.broadcast(spark.createDataFrame(layout, "bucket int, pure boolean, r_at int, nr int, a_at int, na int"))  # BUCKETS rows at most
    dealt = lambda at, n: (F.col(at) + F.pmod(F.xxhash64("uid"), F.col(n))).cast("int").alias("block")
    v = v.join(plan, "bucket")
    row_shards = scratch.save(_shards(v.select("*", dealt("r_at", "nr")), dims, kind, chunks), "row-shards").join(plan, "bucket")
    anchors = v.filter("anchor").select("*", dealt("a_at", "na"))
    inside = lambda at, n: F.sequence(F.col(at), F.col(at) + F.col(n) - 1)
    shard = ("chunk", "n", "part", "ids")

    def own_label(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        found = [(np.zeros(0, np.int64),) * 4]
        for i, (_, uid, lab) in enumerate(a.T):
            others = np.flatnonzero((b[2] == lab) & (b[1] != uid))
            near = others[best(total[i, others], positives)]
            found.append((np.full(len(near), uid), b[0, near], b[1, near], total[i, near]))
        return _joined(found)

    # Positives: tiles of one bucket.
    a = _shards(anchors, dims, kind, chunks).join(plan, "bucket")
    a = a.select(F.col("block").alias("a_block"), F.explode(inside("r_at", "nr")).alias("r_block"), *shard)
    b = row_shards.filter("na > 0").select(F.explode(inside("a_at", "na")).alias("a_block"), F.col("block").alias("r_block"), *shard)
    found = _tiles(a, b, kind, own_label, ["anchor", "positive_id", "puid", "score"])
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "puid")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    found = scratch.save(found.select("anchor", "place", "positive_id", "score"), "positives")

    # Negatives: all other tiles, with the positives' scores of each anchor; those it lacks are below any.
    absent = -(1 << 63)
    windows = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("m"))  # positives at most
    windows = windows.select(F.col("anchor").alias("uid"), F.array(*[F.coalesce(F.try_element_at("m", F.lit(i + 1)), F.lit(absent)) for i in range(positives)]).alias("windows"))

    def other_labels(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        found = [(np.zeros(0, np.int64),) * 5]
        for i in range(a.shape[1]):
            others = np.flatnonzero(b[2] != a[2, i])
            score = total[i, others]
            for w, positive in enumerate(a[3:, i].tolist()):
                if positive != absent:
                    inside = np.flatnonzero((score >= -(-low * positive // 100)) & (score <= high * positive // 100))
                    near = inside[best(score[inside], negatives)]
                    at = others[near]
                    found.append((np.full(len(at), a[1, i]), np.full(len(at), w + 1), b[0, at], b[1, at], score[near]))
        return _joined(found)

    with_windows = anchors.join(windows, "uid")
    a = _shards(with_windows, dims, kind, chunks, positives).join(plan, "bucket")
    outside = lambda block, at, n: ~(F.col("pure") & (F.col(block) >= F.col(at)) & (F.col(block) < F.col(at) + F.col(n)))
    a = a.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(r_at - 1)))).filter(outside("r_block", "r_at", "nr")).select(F.col("block").alias("a_block"), "r_block", *shard)
    b = row_shards.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(a_at - 1)))).filter(outside("a_block", "a_at", "na")).select("a_block", F.col("block").alias("r_block"), *shard)
    mined = _tiles(a, b, kind, other_labels, ["anchor", "place", "negative_id", "nuid", "negative_score"])
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "nuid")
    mined = scratch.save(mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives), "negatives")
    named = found.select("anchor", "place", "positive_id", F.col("score").alias("positive_score"))
    out = mined.join(named, ["anchor", "place"]).join(v.filter("anchor").select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
