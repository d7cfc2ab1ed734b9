"""Exact search for the largest inner products by a Voronoi join.

Pivots are vectors picked by their hash. A vector belongs to the cell of its nearest pivot. One pass over the vectors finds, for each
cell i of queries with pivot p and radius R (its farthest query), a score that every query of the cell is sure to reach k times:
x gives at least p.x - R|x|, and the (k + 1)-th largest of these is the cell's bound. A second pass sends x to a group of neighbouring
cells only if p.x + R|x|, the most it can score there, reaches the bound of one of its cells. Each group is solved by itself: queries
in blocks of at most about `block`, the rows that came to it in slots of at most about `slot_rows`, all of one slot in a matrix product.

Equal vectors are one row with the smallest k + 1 of their ids, so copies neither crowd a task nor push each other out; how many cells a
vector is sent to depends on the spread of the data. Directions at random in many dimensions bound nothing: there every group gets all
rows, and the job is a block-wise comparison of the stated queries with all rows.

Defined results: vectors that are null, empty, hold null or non-finite components, or have another number of dimensions than most take
no part, nor do rows with a null id; zero vectors do, with score 0. Equal scores go by smaller vec_id, then by place. Rows are told apart
by their place, so repeated vec_ids are candidates of each other and queries each. Other columns are ignored, whatever their names. An
empty table gives no rows. Scores are 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .int_vectors import packed, products, to_numbers

RESULT = "query_id long, rank int, vec_id long, score long"
#: Scores that one matrix product makes at a time.
TILE = 1 << 22
#: Slack of bounds, relative to the sizes they come from: far above what rounding of double numbers makes, far below a step of the scores of usual vectors.
SLACK = 1e-9


def _groups_of(pivots: np.ndarray, groups: int) -> np.ndarray:
    """The group of each cell: the nearest of the first pivots."""
    heads = pivots[:groups]
    return ((pivots[:, None] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)


def needed(dots: np.ndarray, length: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """(rows, cells): whether a row's most possible score in a cell reaches what the cell's queries are sure of. dots: with the cells' pivots."""
    reach = radius * length[:, None]
    most = dots + reach
    return most + SLACK * (np.abs(most) + reach + np.abs(bound)) >= bound


def top(score: np.ndarray, lowest: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, best first, equal ones by the smaller id."""
    near = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, -k)[-k])
    return near[np.lexsort((lowest[near], -score[near]))][:k]


def search_exactly(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = 128, groups: int = 16, block: int = 8192, slot_rows: int = 1 << 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x) for each row that is_query marks, among all other rows. vectors: vec_id, embedding."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "knn-join")
    made = packed(vectors.filter("vec_id is not null"), F.col("embedding"), scale, vec_id=F.col("vec_id").cast("long"), q=F.coalesce(is_query, F.lit(False)))
    if made is None:
        return spark.createDataFrame([], RESULT)
    dims, kind = made.dims, made.kind
    rows = scratch.save(made.rows.withColumn("uid", F.monotonically_increasing_id()), "usable")  # written at once, so a row keeps its number

    # Of equal vectors only the k + 1 smallest ids can be among the best.
    nth = F.row_number().over(Window.partitionBy("code").orderBy("vec_id", "uid"))
    firsts = rows.select("code", "vec_id", "uid", nth.alias("nth")).filter(F.col("nth") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("ids"))  # k + 1 at most
    asked = rows.groupBy("code").agg(F.max("q").alias("q"))
    distinct = firsts.join(asked, "code").select(F.col("ids")[0]["uid"].alias("did"), F.col("ids")[0]["vec_id"].alias("lowest"), "ids", "code", "q")
    distinct = scratch.save(distinct, "distinct")
    picked = distinct.orderBy(F.xxhash64("code"), "code").select("code").limit(pivots).toPandas()["code"]  # pivots rows
    centre = np.frombuffer(b"".join(picked), kind).reshape(-1, dims).astype(np.float64)
    centre_sq, n_cells, wide = (centre**2).sum(axis=1), len(centre), k + 1

    def sizes(code: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, their inner products with the pivots and their lengths."""
        x = to_numbers(code, kind, dims).astype(np.float64)
        return x, x @ centre.T, np.sqrt((x**2).sum(axis=1))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, dots, _ = sizes(b.column("code"))
            cell = (centre_sq - 2 * dots).argmin(axis=1)
            radius = np.sqrt(((x - centre[cell]) ** 2).sum(axis=1))
            yield pa.record_batch([b.column("did"), b.column("code"), pa.array(cell.astype(np.int32)), pa.array(radius)], names=["did", "code", "cell", "radius"])

    queries = scratch.save(distinct.filter("q").select("did", "code").mapInArrow(celled, "did long, code binary, cell int, radius double"), "queries")
    summary = queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()  # a row for each pivot at most
    if not summary:
        return spark.createDataFrame([], RESULT)
    group = _groups_of(centre, groups)
    cells = np.array(sorted(r["cell"] for r in summary))
    radius = np.zeros(n_cells)
    radius[[r["cell"] for r in summary]] = [r["radius"] for r in summary]
    in_group = np.bincount(group[[r["cell"] for r in summary]], [r["n"] for r in summary], n_cells).astype(np.int64)
    parts = np.maximum(1, -(-in_group // block))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best scores that a batch's rows are sure to give to each cell."""
        for b in batches:
            _, dots, length = sizes(b.column("code"))
            least = dots[:, cells] - radius[cells] * length[:, None]
            best = -np.sort(-least, axis=0)[:wide]
            yield pa.record_batch([pa.array(np.tile(cells.astype(np.int32), len(best))), pa.array(best.reshape(-1))], names=["cell", "least"])

    reached = distinct.select("code").mapInArrow(sure, "cell int, least double")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("least")))
    bounds = reached.withColumn("place", place).filter(F.col("place") == wide).select("cell", "least").collect()  # a row for each pivot at most
    bound = np.full(n_cells, -np.inf)  # a cell without k + 1 rows takes them all
    bound[[r["cell"] for r in bounds]] = [r["least"] for r in bounds]
    by_group = [(g, cells[group[cells] == g]) for g in np.unique(group[cells])]

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows once for each block of queries of each group that one of them may serve."""
        for b in batches:
            _, dots, length = sizes(b.column("code"))
            for g, own in by_group:
                need = needed(dots[:, own], length, radius[own], bound[own]).any(axis=1)
                if need.any():
                    sent = b.filter(pa.array(need))
                    for part in range(int(parts[g])):
                        key = pa.array(np.full(sent.num_rows, g * (1 << 20) + part, np.int64))
                        yield pa.record_batch([key, *[sent.column(c) for c in ("slot", "did", "lowest", "code")]], names=["home", "slot", "did", "lowest", "code"])

    slots = max(1, -(-distinct.count() // slot_rows))
    data = distinct.select(F.pmod(F.xxhash64("did"), F.lit(slots)).cast("int").alias("slot"), "did", "lowest", "code").mapInArrow(replicated, "home long, slot int, did long, lowest long, code binary")
    part = lambda n: F.pmod(F.xxhash64(F.lit(3), "did"), F.element_at(F.array(*[F.lit(int(x)) for x in n]), F.col("g") + 1))
    home = queries.withColumn("g", F.element_at(F.array(*[F.lit(int(x)) for x in group]), F.col("cell") + 1))
    home = home.select((F.col("g").cast("long") * (1 << 20) + part(parts)).alias("home"), F.col("did").alias("qid"), "code").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def solved(asks: pa.Table, near: pa.Table) -> pa.Table:
        """The best rows of one slot for each query of one block."""
        out = [[], [], [], []]
        if asks.num_rows and near.num_rows:
            q, x = to_numbers(asks["code"], kind, dims), to_numbers(near["code"], kind, dims)
            qid, did, lowest = (np.asarray(c) for c in (asks["qid"], near["did"], near["lowest"]))
            step = max(1, TILE // len(x))
            for i in range(0, len(q), step):
                for who, score in zip(qid[i : i + step], products(q[i : i + step], x), strict=True):
                    best = top(score, lowest, wide)
                    for column, values in zip(out, (np.full(len(best), who), did[best], lowest[best], score[best]), strict=True):
                        column.append(values)
        joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(c, pa.int64()) for c in joined], names=["qid", "did", "lowest", "score"])

    found = home.groupBy("home", "slot").cogroup(data.groupBy("home", "slot")).applyInArrow(solved, "qid long, did long, lowest long, score long")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "lowest"))
    found = scratch.save(found.withColumn("place", best).filter(F.col("place") <= wide).select("qid", "did", "score"), "found")
    # Copies are put back: k + 1 vectors of at most k + 1 rows each, for each query row of a vector.
    ids = found.join(distinct.select("did", "ids"), "did").select("qid", "score", F.explode("ids").alias("at"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("at")["vec_id"], F.col("at")["uid"])
    ids = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= wide)
    best_rows = ids.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "score", F.col("at")["vec_id"].alias("vec_id"), F.col("at")["uid"].alias("uid")))).alias("best"))  # k + 1
    asks = rows.filter("q").select("code", F.col("vec_id").alias("query_id"), "uid").join(distinct.filter("q").select("code", F.col("did").alias("qid")), "code").drop("code")
    hits = asks.join(best_rows, "qid").select("query_id", F.posexplode(F.slice(F.filter("best", lambda r: r["uid"] != F.col("uid")), 1, k)).alias("place", "r"))
    return hits.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("r")["vec_id"].alias("vec_id"), F.col("r")["score"].alias("score"))
