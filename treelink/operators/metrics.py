"""Ranking metrics of scored pairs (label 1 or 0, score), in one pass over distinct scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw
from ..scratch import Scratch
from .moves import counters, lengths
from .order import prefix_sums


def by_score(scored: DataFrame) -> DataFrame:
    """score, p, n, cp, cn: positives and negatives at and down to each distinct score."""
    per = scored.groupBy("score").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("n"))
    run = prefix_sums(per, [F.desc("score")], {"ap": F.col("p"), "an": F.col("n")})
    return run.select("score", "p", "n", (F.col("ap") + F.col("p")).alias("cp"), (F.col("an") + F.col("n")).alias("cn"))


def ranking_metrics(scored: DataFrame, ks: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """One row: roc_auc, average_precision, mrr_opt, mrr_pess, f1 and hits at each k; ties count one half in AUC and hits."""
    s = Scratch(scored.sparkSession, "metrics").save(by_score(scored), "by-score")
    t = s.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    j = s.crossJoin(F.broadcast(t))  # one row of totals
    p, n, cp, cn, P, N = (F.col(c).cast("double") for c in ("p", "n", "cp", "cn", "all_p", "all_n"))
    aggs = [
        F.sum(n * (cp - p / 2) / (P * N)).alias("roc_auc"),
        F.sum(p / P * cp / (cp + cn)).alias("average_precision"),
        F.sum(p / (cn - n + 1) / P).alias("mrr_opt"),
        F.sum(p / (cn + 1) / P).alias("mrr_pess"),
        # the threshold is the P-th largest score: the first group with cp + cn >= P
        F.min(F.when(cp + cn >= P, F.struct((cp + cn).alias("all"), (F.lit(2.0) * cp / (cp + cn + P)).alias("f1")))).getField("f1").alias("f1"),
    ]
    for k in ks:
        hit = F.when(N < k, F.lit(1.0)).when(cn < k, F.lit(1.0)).when(cn - n < k, F.lit(0.5)).otherwise(F.lit(0.0))
        aggs.append(F.sum(p * hit / P).alias(f"hits{k}"))
    out = j.agg(*aggs)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def node_negatives(edges: DataFrame, ids: DataFrame, n: int, ratio: int, seed: int = 1) -> DataFrame:
    """src, dst, neg: for each edge `ratio` uniform nodes in place of its target, edges and repeats included. ids: node, idx of n nodes."""
    drawn = edges.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("i"))
    drawn = drawn.withColumn("idx", draw(seed, "nm", F.col("src"), F.col("dst"), F.col("i")) % n)
    return drawn.join(ids.select("idx", F.col("node").alias("neg")), "idx").select("src", "dst", "neg")


def node_mrr(edges: DataFrame, score, ids: DataFrame, n: int, ratio: int = 100, seed: int = 1) -> DataFrame:
    """One row: optimistic and pessimistic mean reciprocal rank of each edge among its own negatives.

    score: adds column score to pairs src, dst. Edges that score() leaves out have no rank.
    """
    own = score(edges.select("src", "dst")).withColumnRenamed("score", "own")
    drawn = node_negatives(edges, ids, n, ratio, seed).withColumnRenamed("dst", "target")
    other = score(drawn.withColumnRenamed("neg", "dst")).select("src", F.col("target").alias("dst"), "score")
    per = own.join(other, ["src", "dst"]).groupBy("src", "dst").agg(F.sum((F.col("score") > F.col("own")).cast("int")).alias("above"), F.sum((F.col("score") >= F.col("own")).cast("int")).alias("upto"))
    return per.agg(F.round(F.avg(F.lit(1.0) / (F.col("above") + 1)), 9).alias("mrr_opt"), F.round(F.avg(F.lit(1.0) / (F.col("upto") + 1)), 9).alias("mrr_pess"))


def node_mrr_blocks(edges: DataFrame, model, ids: DataFrame, n: int, ratio: int = 1000, seed: int = 1, block: int = 1 << 20, rows: int = 1 << 14) -> DataFrame:
    """node_mrr of a model (of operators.training), without a row for each negative.

    The places and degrees of a block of `block` nodes meet a slice of edges in one task, which looks negatives up there and counts those
    that rank above; counts of blocks add up. Where all nodes are one block, the task draws them itself. With more blocks an edge's
    negatives are drawn once and cut by blocks: 4 bytes of shuffle for each, and a row for each block that one falls into. A slice has
    about `rows` edges, or a quarter as many as a block has nodes, so that nodes sent to slices are as many as edges, times four.
    """
    cfg, scratch, spark = model.cfg, Scratch(edges.sparkSession, "node-mrr"), edges.sparkSession
    head, tail = (model.vectors.get("z", model.vectors.get(x)) for x in ("head", "tail"))
    place = lambda of, d, z, deg: of.join(model.deg, "node", "left").select("node", F.col("z").alias(z), F.coalesce(d, F.lit(0)).cast("double").alias(deg))
    e = edges.select("src", "dst").join(place(head, "d1", "z1", "deg1").withColumnRenamed("node", "src"), "src").join(place(tail, "d2", "z2", "deg2").withColumnRenamed("node", "dst"), "dst")
    size = min(block, n)
    blocks, slices = -(-n // size), max(1, -(-edges.count() // max(rows, size // 4)))
    e = e.select(F.pmod(F.xxhash64("src", "dst"), F.lit(slices)).cast("int").alias("slice"), "src", "dst", "z1", "deg1", "z2", "deg2")
    nodes = ids.join(place(tail, "d2", "z", "deg"), "node").select(F.floor(F.col("idx") / size).cast("int").alias("block"), (F.col("idx") % size).cast("int").alias("at"), "z", "deg")
    nodes = nodes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    tails, most = [str(i) for i in range(ratio)], cfg.height * cfg.dims + 1
    step = max(1, (1 << 18) // max(1, ratio))

    def drawn(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Numbers of the nodes that node_negatives draws for each edge (edges, ratio)."""
        return counters([f"{seed}|nm|{a}|{b}|" for a, b in zip(src.tolist(), dst.tolist(), strict=True)], tails) % n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each edge and block that its negatives fall into, with their numbers within it."""
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                at = np.sort(drawn(np.asarray(part["src"]), np.asarray(part["dst"])), axis=1)
                key = (np.arange(len(at))[:, None] * blocks + at // size).reshape(-1)
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                lists = pa.ListArray.from_arrays(np.r_[first, len(key)].astype(np.int32), pa.array((at % size).reshape(-1).astype(np.int32)))
                out = part.take(pa.array(key[first] // blocks))
                yield pa.RecordBatch.from_arrays([pa.array((key[first] % blocks).astype(np.int32)), *out.columns, lists], names=["block", *out.schema.names, "drawn"])

    def score(total: np.ndarray, deg1: np.ndarray | float, deg2: np.ndarray) -> np.ndarray:
        """link_probability, rounded as ranks compare it."""
        norm = np.log((deg1 + 1) * (deg2 + 1))
        with np.errstate(divide="ignore"):
            p = 1 / (1 + ((total / cfg.dims + cfg.eps) / norm) ** cfg.gamma / cfg.alpha)
        return np.round(np.where(norm > 0, p, 0.0), 9)

    def counted(asks: pa.Table, near: pa.Table) -> pa.Table:
        matrix = lambda t, c: np.asarray(t[c].combine_chunks().flatten()).reshape(-1, cfg.dims)
        asks = asks.sort_by("deg1")
        z1, deg1, src, dst = matrix(asks, "z1"), np.asarray(asks["deg1"]), np.asarray(asks["src"]), np.asarray(asks["dst"])
        mine = score(lengths(z1 ^ matrix(asks, "z2"), cfg.height).sum(axis=1, dtype=np.int64), deg1, np.asarray(asks["deg2"]))
        above, upto = np.zeros(len(z1), np.int64), np.zeros(len(z1), np.int64)
        degrees, which = np.unique(np.asarray(near["deg"]), return_inverse=True)
        z, level, at = np.zeros((cfg.dims, size), np.uint16 if cfg.height <= 16 else np.int64), np.zeros(size, np.int32), np.asarray(near["at"])
        level[at] = which
        z[:, at] = matrix(near, "z").T
        z1 = z1.astype(z.dtype)
        starts = np.r_[np.flatnonzero(np.r_[True, deg1[1:] != deg1[:-1]]), len(z1)] if len(z1) else np.zeros(1, int)
        for low, high in zip(starts, starts[1:], strict=False):  # edges whose sources have the same degree
            table = score(np.arange(most), deg1[low], degrees[:, None]) if len(degrees) * most <= (high - low) * ratio else None
            for i in range(low, high, step):
                j = min(high, i + step)
                if blocks == 1:
                    of, counts = drawn(src[i:j], dst[i:j]).reshape(-1), ratio
                else:
                    lists = asks["drawn"].slice(i, j - i).combine_chunks()
                    of, counts = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
                who = np.repeat(np.arange(i, j), counts)
                total = np.zeros(len(of), np.int64)
                for t in range(cfg.dims):
                    total += lengths(z1[who, t] ^ z[t][of], cfg.height)
                other = score(total, deg1[low], degrees[level[of]]) if table is None else table[level[of], total]
                above[i:j] = np.bincount(who - i, other > mine[who], j - i)
                upto[i:j] = np.bincount(who - i, other >= mine[who], j - i)
        return pa.table({"src": src, "dst": dst, "above": above, "upto": upto})

    if blocks == 1:
        e = e.withColumn("block", F.lit(0))
    else:
        e = e.mapInArrow(cut, "block int, slice int, src long, dst long, z1 array<long>, deg1 double, z2 array<long>, deg2 double, drawn array<int>")
    tasks = max(blocks * slices, int(spark.conf.get("spark.sql.shuffle.partitions")))  # by number, so that few bytes with much work stay apart
    e, nodes = e.repartition(tasks, "block", "slice"), nodes.repartition(tasks, "block", "slice")
    per = e.groupBy("block", "slice").cogroup(nodes.groupBy("block", "slice")).applyInArrow(counted, "src long, dst long, above long, upto long")
    per = scratch.save(per, "counts").groupBy("src", "dst").agg(F.sum("above").alias("above"), F.sum("upto").alias("upto"))
    return per.agg(F.round(F.avg(F.lit(1.0) / (F.col("above") + 1)), 9).alias("mrr_opt"), F.round(F.avg(F.lit(1.0) / (F.col("upto") + 1)), 9).alias("mrr_pess"))


def all_metrics(scored: DataFrame, by_node: DataFrame | None = None, ks: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """ranking_metrics, with the mean reciprocal ranks of by_node (a row of node_mrr) in place of those over all negatives where it is given."""
    out = ranking_metrics(scored, ks)
    return out if by_node is None else out.drop("mrr_opt", "mrr_pess").crossJoin(by_node)  # one row each


def run_grid(runs: DataFrame, by: list[str], turn: str, turns: list[int]) -> DataFrame:
    """runs with a row of nulls for each of the expected turns that a group has no run of."""
    expected = runs.select(*by).distinct().withColumn(turn, F.explode(F.array(*[F.lit(t) for t in turns])))
    return expected.join(runs, [*by, turn], "left")


def _two_places(c: str) -> Column:
    """A number with two places, ties of its exact value to even; Java's format takes them up, and ties of its shortest digits for ties. Null for null."""

    def shown(x: pd.Series) -> pd.Series:
        return x.map("{:.2f}".format, na_action="ignore").astype(object)

    return F.pandas_udf(shown, "string")(c)


def run_summary(runs: DataFrame, by: list[str], metrics: list[str], missing_as_zero: bool = False) -> DataFrame:
    """Mean and population standard deviation of each metric in percent, as text. Runs without a value are left out, or count as 0 if asked for; run_grid adds those without a row."""
    value = lambda m: F.coalesce(F.col(m), F.lit(0.0)) if missing_as_zero else F.col(m)
    moments = [x for i, m in enumerate(metrics) for x in ((F.avg(value(m)) * 100).alias(f"_avg_{i}"), (F.stddev_pop(value(m)) * 100).alias(f"_std_{i}"))]
    text = lambda c: F.when(F.isnan(c), "nan").otherwise(_two_places(c))
    return runs.groupBy(*by).agg(*moments).select(*by, *[F.concat(text(f"_avg_{i}"), F.lit("±"), text(f"_std_{i}")).alias(m) for i, m in enumerate(metrics)])


def run_statistics(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """The numbers of run_summary for one metric: mean and std."""
    return runs.groupBy(*by).agg(F.round(F.avg(metric), 9).alias("mean"), F.round(F.stddev_pop(metric), 9).alias("std"))
