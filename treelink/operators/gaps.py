"""Pairs that are no edges, by rank: the j-th neighbour that a node lacks lies in a gap between its sorted neighbours.

Gaps are found in one order over all (node, neighbour) rows, so a hub is no task of its own. Their lengths add up to a rank for each free
pair; a rank is looked up as the last gap that starts at or before it, in one order over gaps and ranks together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw
from ..scratch import Scratch
from .order import last_before, prefix_sums, transitions

#: Neighbours of a gap that one row lists.
PIECE = 1 << 16


def gaps(taken: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """i, start, len: runs of numbers in [low, n) that a source i (i, low) hasn't among its taken ones (i, x)."""
    inside = taken.join(sources, "i").filter((F.col("x") >= F.col("low")) & (F.col("x") < n)).select("i", "x").distinct()
    rows = inside.unionByName(sources.select("i", (F.col("low") - 1).alias("x"))).unionByName(sources.select("i", F.lit(n).cast("bigint").alias("x")))
    steps = transitions(rows.withColumn("v", F.struct("i", "x")), ["i", "x"], "v")
    a, b = F.col("src"), F.col("dst")
    out = steps.filter(a["i"] == b["i"]).select(a["i"].alias("i"), (a["x"] + 1).alias("start"), (b["x"] - a["x"] - 1).alias("len"))
    return out.filter("len > 0")


def listed(runs: DataFrame) -> DataFrame:
    """i, x: all numbers of the gaps."""
    pieces = runs.select("i", F.col("start").alias("s"), F.col("len").alias("n"), F.explode(F.expr(f"sequence(0L, (len - 1) div {PIECE})")).alias("p"))
    low = F.col("s") + F.col("p") * PIECE
    return pieces.select("i", F.explode(F.sequence(low, F.least(F.col("s") + F.col("n"), low + PIECE) - 1)).alias("x"))


def strata(j: Column, free: Column, wanted: Column, *key: Column | str | int) -> Column:
    """The j-th of `wanted` ranks below free (at least as many): one drawn from each of as many strata of equal size, so all differ."""
    div = lambda a, b: F.call_function("div", a, b)
    edge = lambda i: i * div(free, wanted) + div(i * (free % wanted), wanted)
    low = edge(j)
    return low + draw(*key) % (edge(j + 1) - low)


def ranked(runs: DataFrame, ranks: DataFrame, within: bool = False) -> DataFrame:
    """i, x for ranks (r) among all numbers of the gaps in the order (i, start); within: for ranks (i, r) among those of the source i."""
    run = prefix_sums(runs, ["i", "start"], {"before": F.col("len")})
    if within:
        run = Scratch(runs.sparkSession, "gaps").save(run, "run")
        first = run.groupBy("i").agg(F.min("before").alias("first"))
        ranks = ranks.join(first, "i").select((F.col("r") + F.col("first")).alias("r"))
    nothing = F.lit(None).cast("struct<i: bigint, start: bigint, before: bigint>")
    both = run.select(F.col("before").alias("r"), F.lit(0).alias("kind"), F.struct("i", "start", "before").alias("gap"))
    both = both.unionByName(ranks.select(F.col("r").cast("bigint").alias("r"), F.lit(1).alias("kind"), nothing.alias("gap")))
    found = last_before(both, ["r", "kind"], "gap", "in_gap").filter("kind = 1")
    return found.select(F.col("in_gap")["i"].alias("i"), (F.col("in_gap")["start"] + F.col("r") - F.col("in_gap")["before"]).alias("x"))
