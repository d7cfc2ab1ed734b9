"""Maximum inner product search with score-aware (anisotropic) product quantisation and four-bit table scans.

Vectors are coded as a length, one of at most `MAX_ANCHORS` anchors near their direction, how far they are from it, and, for each dimension of the
way there (or subspace of `width` dimensions), one of 16 centres. So rows that crowd together are told apart as finely as rows all over: error is a
share of the way to the anchor, which is a median, moved by no few rows far off. Codes and centres minimise a loss
in which residual error along the vector, which changes inner products most, weighs `eta` times as much as error across it. Anchors and centres
are fitted on at most about 2 `sample_rows` directions picked by a hash; every vector is coded and searched. Lengths stay double numbers,
so a few very long vectors spoil no centre. Equal vectors are one code with their smallest ids.

Directions are dealt to cells by the same loss. A query goes to the cells whose centres it agrees with most, to as many as hold
`recall` of the nearest rows of sampled queries within the sample; these lie farther out than the nearest of all rows, so the number
errs to the safe side. Where that is more than half of the cells, as with directions that form no groups, there is one cell that
holds all rows. Blocks of a cell meet its queries, a slice at a time, and only codes travel there: sums of table entries pick
`shortlist` codes and those that tie with the last. The best of all cells are joined with their vectors and scored exactly in double
precision, and copies are put back by their ids.

Defined results: null vectors and zero vectors, and those with null or non-finite components or another number of dimensions than
most, take no part; equal scores go by smaller vec_id; rows are told apart by their place, so repeated vec_ids are candidates of each
other and queries each, with their rows of results one after the other; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Codes in a block, queries that meet it in a task, queries scanned at a time, and queries scored at a time.
BLOCK, VISITORS, SCAN, QUERY_BLOCK = 1 << 15, 2048, 64, 512
#: Codes a cell on average, cells at most, and queries that settle how many cells are visited.
CELL, MAX_CELLS, ASKED = 1 << 9, 1024, 256
#: Anchors at most.
MAX_ANCHORS = 1024


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (single precision) and lengths (double), of rows of any finite size."""
    most = np.abs(x).max(axis=1, keepdims=True)
    y = x / most
    length = np.sqrt((y * y).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        return (y / length).astype(np.float32), (length * most)[:, 0]


class AnisotropicCoder:
    """Product quantiser of four bits per subspace. eta: weight of the error parallel to the vector, relative to the rest."""

    def __init__(self, dims: int, width: int = 2, eta: float = 4.0):
        self.dims, self.width, self.eta = dims, width, eta
        self.spaces = -(-dims // width)
        self.centres = np.zeros((self.spaces, 16, width), np.float32)

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, spaces, width), with zeros where dims are no multiple of the width."""
        full = np.zeros((len(x), self.spaces * self.width), np.float32)
        full[:, : self.dims] = x
        return full.reshape(len(x), self.spaces, self.width)

    def along(self, x: np.ndarray, of: np.ndarray | None) -> np.ndarray:
        """Unit vectors, split, that errors are parallel to: of the rows themselves, or of the vectors `of` that they are parts of."""
        of = x if of is None else of
        return self.split(of) / np.maximum(np.linalg.norm(of, axis=1), 1e-12)[:, None, None].astype(np.float32)

    def encode(self, x: np.ndarray, passes: int = 2, of: np.ndarray | None = None) -> np.ndarray:
        """Codes by coordinate descent: each subspace is chosen again given the parallel error of the others."""
        parts, unit = self.split(x), self.along(x, of)
        codes = np.empty(parts.shape[:2], np.uint8)
        along = np.empty(parts.shape[:2], np.float32)
        for m in range(self.spaces):
            gap = parts[:, m, None, :] - self.centres[m]
            codes[:, m] = (gap**2).sum(axis=2).argmin(axis=1)
            along[:, m] = ((parts[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(passes):
            for m in range(self.spaces):
                gap = parts[:, m, None, :] - self.centres[m]
                par = (gap * unit[:, m, None, :]).sum(axis=2)
                rest = total - along[:, m]
                loss = (gap**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + par) ** 2
                best = loss.argmin(axis=1)
                codes[:, m], along[:, m] = best, par[np.arange(len(x)), best]
                total = rest + along[:, m]
        return codes

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 1, of: np.ndarray | None = None) -> AnisotropicCoder:
        parts, rng, unit = self.split(x), np.random.default_rng(seed), self.along(x, of)
        for m in range(self.spaces):
            self.centres[m] = parts[rng.choice(len(x), 16, replace=len(x) < 16), m]
        eye = np.eye(self.width)
        for r in range(rounds):
            codes = self.encode(x, passes=0 if r < 2 else 1, of=of)
            along = np.stack([((parts[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1) for m in range(self.spaces)], axis=1)
            total = along.sum(axis=1)
            for m in range(self.spaces):
                u, v, rest = unit[:, m].astype(float), parts[:, m].astype(float), total - along[:, m]
                for c in range(16):
                    on = codes[:, m] == c
                    if not on.any():
                        continue
                    uo, vo = u[on], v[on]
                    a = on.sum() * eye + (self.eta - 1) * uo.T @ uo
                    b = vo.sum(axis=0) + (self.eta - 1) * (uo * (rest[on] + (uo * vo).sum(axis=1))[:, None]).sum(axis=0)
                    self.centres[m, c] = np.linalg.solve(a, b)
                along[:, m] = ((parts[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1)
                total = rest + along[:, m]
        return self

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, spaces, 16): inner products of the query's parts with the centres."""
        return np.einsum("qmw,mcw->qmc", self.split(queries), self.centres).astype(np.float32)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows): a table of 256 sums for each packed byte is looked up and added."""
        t = self.tables(queries)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        pairs = (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(t), t.shape[1] // 2, 256)
        out = np.zeros((len(packed), len(t)), np.float32)
        for m in range(packed.shape[1]):
            out += np.ascontiguousarray(pairs[:, m].T)[packed[:, m]]
        return out.T


class Anchors:
    """Points near directions; what is coded is the way from there."""

    def __init__(self, points: np.ndarray):
        self.points = points

    @classmethod
    def fit(cls, unit: np.ndarray, count: int, rounds: int = 3, seed: int = 1) -> Anchors:
        """Points far from those before, 64 at a time, moved to the medians of the directions nearest to them."""
        x, rng = unit.astype(np.float64), np.random.default_rng(seed)
        points, far = x[:1], ((x - x[0]) ** 2).sum(axis=1)
        while len(points) < count and (far > 1e-14).any():
            chance = np.where(far > 1e-14, far, 0)
            more = np.unique(rng.choice(len(x), min(64, count - len(points)), p=chance / chance.sum()))
            points = np.concatenate([points, x[more]])
            far = np.minimum(far, np.maximum(1 + (x[more] ** 2).sum(axis=1) - 2 * x @ x[more].T, 0).min(axis=1))
        found = cls(points)
        for _ in range(rounds):
            of = found.assign(x)
            order = np.argsort(of, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                found.points[of[own[0]]] = np.median(x[own], axis=0)
        return found

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The nearest point of each direction."""
        size, out = (self.points**2).sum(axis=1), np.empty(len(unit), np.int32)
        for i in range(0, len(unit), 4096):
            out[i : i + 4096] = (size - 2 * (unit[i : i + 4096] @ self.points.T)).argmin(axis=1)
        return out

    def ways(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchor of each direction, how far it is, and the unit vector of the way from there (zeros where it is no way)."""
        at = self.assign(unit)
        way = unit - self.points[at]
        far = np.sqrt((way**2).sum(axis=1))
        return at, far.astype(np.float32), (way / np.maximum(far, 1e-30)[:, None]).astype(np.float32)


class Cells:
    """Coarse cells of directions, with centres that minimise the anisotropic loss."""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    @classmethod
    def fit(cls, unit: np.ndarray, cells: int, eta: float = 4.0, rounds: int = 8, seed: int = 1) -> Cells:
        x, rng = unit.astype(np.float64), np.random.default_rng(seed)
        found = cls(x[rng.choice(len(x), cells, replace=False)], eta)
        for _ in range(rounds):
            of = found.assign(x)
            for c in range(cells):
                own = x[of == c]
                if len(own):  # the least of the loss of unit vectors, whose parallel error is 1 - x c
                    found.centres[c] = np.linalg.solve(len(own) * np.eye(x.shape[1]) + (eta - 1) * own.T @ own, eta * own.sum(axis=0))
        return found

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each direction."""
        size, out = (self.centres**2).sum(axis=1), np.empty(len(unit), np.int32)
        for i in range(0, len(unit), 4096):
            s = unit[i : i + 4096] @ self.centres.T
            out[i : i + 4096] = (size - 2 * s + (self.eta - 1) * (1 - s) ** 2).argmin(axis=1)
        return out

    def order(self, queries: np.ndarray) -> np.ndarray:
        """All cells for each query, those it agrees with most first."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable").astype(np.int32)

    def visits(self, sample: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
        """How many cells hold `recall` of the k nearest of a sample, on average over the queries."""
        unit, length = directions(sample)
        q, of = directions(queries)[0], self.assign(unit)
        length = length / length.max()
        held = np.zeros(len(self.centres))
        for a in q:
            s = unit @ a * length
            s[(unit == a).all(axis=1)] = -np.inf
            near = np.argsort(-s, kind="stable")[:k]
            place = np.empty(len(self.centres), np.int64)
            place[self.order(a[None])[0]] = np.arange(len(place))
            np.add.at(held, place[of[near[np.isfinite(s[near])]]], 1)
        return int(np.searchsorted(np.cumsum(held), recall * held.sum()) + 1)


def is_usable(v: Column, dims: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dims) & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)


def coarse(sample: np.ndarray, queries: np.ndarray, rows: int, k: int, eta: float, recall: float) -> tuple[Cells, int]:
    """Cells for so many rows, and how many of them a query visits; one cell for all if queries would visit more than half."""
    unit, cells = directions(sample)[0], min(MAX_CELLS, rows // CELL, len(sample) // 16)
    if cells > 2 and len(queries):
        found = Cells.fit(unit, cells, eta)
        visits = found.visits(sample, queries, k, recall)
        if 2 * visits <= cells:
            return found, visits
    return Cells(np.zeros((1, sample.shape[1])), eta), 1


def search(vectors: DataFrame, is_query: Column, k: int = 20, shortlist: int = 200, sample_rows: int = 20_000, width: int = 1, eta: float = 4.0, recall: float = 0.995) -> DataFrame:
    """query_id, rank, vec_id, score for columns vec_id and embedding. is_query marks the rows to search for."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    nothing = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.filter("vec_id is not null and size(e) > 0")
    usual = v.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return spark.createDataFrame([], nothing)
    dims = usual["n"]
    v = v.filter(is_usable(F.col("e"), dims)).withColumn("uid", F.monotonically_increasing_id())  # written at once, so a row keeps its number
    v = scratch.save(v.withColumn("x", F.xxhash64("e")).withColumn("y", F.xxhash64(F.lit(3), F.col("e"))), "usable")
    # Of equal vectors only the k + 1 smallest ids can be among the nearest; the first row stands for all.
    nth = F.row_number().over(Window.partitionBy("x", "y").orderBy("vec_id", "uid"))
    members = v.select("x", "y", "vec_id", "uid").withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    members = members.withColumn("did", F.first("uid").over(Window.partitionBy("x", "y").orderBy("nth")))
    members = scratch.save(members.select("did", "uid", "vec_id", "nth"), "members")
    reps = members.filter("nth = 1").select(F.col("uid"))
    n = reps.count()
    if not n:
        return spark.createDataFrame([], nothing)
    reps = scratch.save(v.join(reps, "uid").select(F.col("uid").alias("did"), "e"), "distinct")
    part = int(np.ceil(min(1.0, sample_rows / n) * 1_000_000))
    # By a hash of the vector and in an order, so that centres don't depend on how rows are dealt out.
    picked = reps.filter(F.pmod(F.xxhash64(F.lit(11), "e"), F.lit(1_000_000)) < part).select("e").limit(2 * sample_rows).toPandas()
    sample = np.array(picked["e"].tolist() or reps.orderBy(F.xxhash64("e"), "e").select("e").limit(1).toPandas()["e"].tolist(), np.float64)
    sample = sample[np.lexsort(sample.T)]
    toward = directions(sample)[0]
    anchors = Anchors.fit(toward, max(1, min(MAX_ANCHORS, len(sample) // 16)))
    coder = AnisotropicCoder(dims, width, eta).fit(anchors.ways(toward)[2], of=toward)

    queries = v.filter("q").select("uid", "vec_id", "e")
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.select("e").orderBy(F.xxhash64("e"), "e").limit(ASKED).toPandas()["e"].tolist()
    cells, visits = coarse(sample, np.array(asked, np.float64).reshape(-1, dims), n, k, eta, recall)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, length = directions(np.asarray(b.column("e").flatten()).reshape(-1, dims))
            at, far, way = anchors.ways(unit)
            packed = coder.pack(coder.encode(way, of=unit))
            yield pa.record_batch({"cell": pa.array(cells.assign(unit)), "did": b.column("did"), "anchor": pa.array(at), "far": pa.array(far), "code": pa.array([c.tobytes() for c in packed], pa.binary()), "length": pa.array(length)})

    coded = scratch.save(reps.select("did", "e").mapInArrow(code, "cell int, did long, anchor int, far float, code binary, length double"), "coded")
    held = np.zeros(len(cells.centres), np.int64)  # MAX_CELLS at most
    for row in coded.groupBy("cell").count().collect():
        held[row["cell"]] = row["count"]
    by_block = F.pmod(F.xxhash64("uid"), F.lit(query_blocks)).cast("int")
    grid = scratch.save(queries.select(by_block.alias("qb"), F.col("uid").alias("quid"), F.col("vec_id").alias("query_id"), "e"), "queries")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = directions(np.asarray(b.column("e").flatten()).reshape(-1, dims))[0]
            order = cells.order(q)
            short = (np.cumsum(held[order], axis=1) < min(shortlist, n)).sum(axis=1) + 1  # small cells are not enough by themselves
            taken = [o[: max(visits, m)] for o, m in zip(order, short, strict=True)]
            yield pa.record_batch({"quid": b.column("quid"), "e": b.column("e"), "cells": pa.array(taken, pa.list_(pa.int32()))})

    visitors = grid.select("quid", "e").mapInArrow(visit, "quid long, e array<double>, cells array<int>").select("quid", "e", F.explode("cells").alias("cell"))
    visitors = scratch.save(visitors, "visitors")

    # At most MAX_CELLS rows: how many blocks a cell's codes make, and how many slices its visitors.
    crowd = visitors.groupBy("cell").count().collect()
    if not crowd:
        return spark.createDataFrame([], nothing)
    met = [(r["cell"], int(-(-held[r["cell"]] // BLOCK)), -(-r["count"] // VISITORS)) for r in crowd if held[r["cell"]]]
    parts, tasks = F.broadcast(spark.createDataFrame(met, "cell int, blocks int, slices int")), min(20_000, sum(b * c for _, b, c in met))
    keys = ["cell", "block", "slice"]
    right = coded.join(parts, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "did"), F.col("blocks")).cast("int"))
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*keys, "did", "anchor", "far", "code", "length").repartition(tasks, *keys)
    left = visitors.join(parts, "cell").withColumn("slice", F.pmod(F.xxhash64(F.lit(7), "quid"), F.col("slices")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, "quid", "e").repartition(tasks, *keys)

    def meet(own: pa.Table, rows: pa.Table) -> pa.Table:
        """The shortlist of each query of a slice among the codes of a block."""
        parts = [pa.table({"quid": pa.array([], pa.int64()), "did": pa.array([], pa.int64()), "rough": pa.array([], pa.float64())})]
        if own.num_rows and rows.num_rows:
            quid, did, at, far, length = (t.column(c).to_numpy() for t, c in ((own, "quid"), (rows, "did"), (rows, "anchor"), (rows, "far"), (rows, "length")))
            q, _ = directions(own.column("e").combine_chunks().flatten().to_numpy().reshape(-1, dims))
            packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(did), -1)
            for i in range(0, len(q), SCAN):
                rough = ((q[i : i + SCAN] @ anchors.points.T)[:, at] + coder.scan(q[i : i + SCAN], packed) * far.astype(np.float64)) * length
                for who, row in zip(quid[i : i + SCAN], rough, strict=True):
                    near = np.arange(len(row)) if len(row) <= shortlist else np.flatnonzero(row >= -np.partition(-row, shortlist - 1)[shortlist - 1])
                    parts.append(pa.table({"quid": np.full(len(near), who), "did": did[near], "rough": row[near].astype(np.float64)}))
        return pa.concat_tables(parts)

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "quid long, did long, rough double")
    near = near.withColumn("place", F.rank().over(Window.partitionBy("quid").orderBy(F.desc("rough")))).filter(F.col("place") <= shortlist)
    near = scratch.save(near.select(F.pmod(F.xxhash64("quid"), F.lit(query_blocks)).cast("int").alias("qb"), "quid", "did"), "near")
    loaded = near.join(reps, "did")

    def exact(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """Scores of the shortlist of one block of queries, a slice at a time."""
        place = pd.Series(np.arange(len(own)), own["quid"])
        q, at, score = np.array(own["e"].tolist(), np.float64).reshape(-1, dims), place.reindex(rows["quid"]).to_numpy(), np.empty(len(rows))
        for i in range(0, len(rows), 8192):
            with np.errstate(over="ignore", invalid="ignore"):
                score[i : i + 8192] = (np.array(rows["e"].iloc[i : i + 8192].tolist(), np.float64) * q[at[i : i + 8192]]).sum(axis=1)
        return pd.DataFrame({"quid": rows["quid"], "did": rows["did"], "score": score})

    scored = loaded.groupBy("qb").cogroup(grid.select("qb", "quid", "e").groupBy("qb")).applyInPandas(exact, "quid long, did long, score double")
    lowest = members.filter("nth = 1").select("did", F.col("vec_id").alias("lowest"))
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "lowest")
    scored = scored.join(lowest, "did").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    hits = scored.select("quid", "did", "score").join(members, "did").filter("uid <> quid").join(grid.select("quid", "query_id"), "quid")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
