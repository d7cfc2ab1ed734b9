"""What training steps read of the graph, in bucketed tables that are written once, so that no step shuffles links.

A kind's links lie there twice: by node, where a masked node picks its one link and where negatives are drawn, and by neighbour, where they
meet the neighbours' coordinates. Only these travel to the links (a row a node, and one for each slice of a hub), and the links with their
far ends to the nodes that move, next to a row for the node itself: one shuffle, without a join after it. A node of more than `hub` links is
cut into slices in both tables, so no bucket and no task holds a hub's links.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw
from ..scratch import Scratch

#: By variant and vector: the kinds of links it moves by with the keys of their losses, and the kind whose links draw negatives with theirs.
VECTORS = {
    "undir": {"z": ({"all": "out"}, ("all", "not_out"))},
    "sr": {"z": ({"out": "out", "in": "in"}, ("all", "neither"))},
    "dr": {"head": ({"out": "out"}, ("out", "not_out")), "tail": ({"in": "in"}, ("in", "not_in"))},
}


@dataclass(frozen=True)
class Laid:
    """about: node, idx, d1, d2. sizes, by vector: node, cnt (its links that draw negatives), parts, a1, a2 (degrees).

    own and far, by kind: node, nbr, part, slice and the columns of sizes, in buckets of (node, part) and of (nbr, slice). spread, by kind:
    node, slices (as a neighbour). Laid by batch, all but about and spread have a column batch with a folder for each of its values.
    """

    variant: str
    about: DataFrame
    sizes: dict[str, DataFrame]
    own: dict[str, DataFrame]
    far: dict[str, DataFrame]
    spread: dict[str, DataFrame]
    names: tuple[str, ...] = ()

    def drop(self, scratch: Scratch) -> None:
        scratch.drop(*self.names)


def kept(cfg, epoch: int) -> Column:
    """Whether the row's node uses all its links in this epoch."""
    masked = epoch <= cfg.convergence * cfg.epochs
    return (draw(cfg.seed, "mask", epoch, F.col("node")) % 1000 < int(cfg.mask_share * 1000)) if masked else F.lit(True)


def lay(links: dict[str, DataFrame], ids: DataFrame, deg: DataFrame, variant: str, hub: int, scratch: Scratch | None = None) -> Laid:
    """links: node, nbr by kind, distinct; ids: node, idx; deg: node, d1, d2; hub: links of a node in one slice."""
    scratch = scratch or Scratch(ids.sparkSession, "laid")
    degree = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    about = scratch.bucketed(ids.join(deg, "node", "left").select("node", F.col("idx").cast("bigint").alias("idx"), degree("d1"), degree("d2")), "about", ["node"])
    laid = Laid(variant, about, {}, {}, {}, {})
    cut = lambda n, x: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    for name, (kinds, (drawn, _)) in VECTORS[variant].items():
        each = [links[k].groupBy("node").agg(F.count("*").alias("rows"), F.lit(0).cast("bigint").alias("cnt")) for k in kinds]
        each.append(links[drawn].groupBy("node").agg(F.count("*").alias("rows"), F.count("*").alias("cnt")))
        per = reduce(DataFrame.unionByName, each).groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("cnt").alias("cnt"))
        per = per.join(about, "node").select("node", "cnt", F.ceil(F.col("rows") / hub).cast("int").alias("parts"), F.col("d1").alias("a1"), F.col("d2").alias("a2"))
        laid.sizes[name] = scratch.bucketed(per, f"sizes-{name}", ["node"])
        for k in {*kinds, drawn}:
            slices = links[k].groupBy(F.col("nbr").alias("node")).agg(F.ceil(F.count("*") / hub).cast("int").alias("slices"))
            laid.spread[k] = scratch.bucketed(slices, f"spread-{k}", ["node"])
            rows = links[k].join(laid.sizes[name], "node").join(laid.spread[k].withColumnRenamed("node", "nbr"), "nbr")
            rows = rows.withColumn("part", cut("parts", "nbr")).withColumn("slice", cut("slices", "node")).drop("slices")
            laid.own[k] = scratch.bucketed(rows, f"own-{k}", ["node", "part"])
            laid.far[k] = scratch.bucketed(laid.own[k], f"far-{k}", ["nbr", "slice"])
    return laid


def in_batches(laid: Laid, plan: DataFrame, epoch: int, scratch: Scratch) -> Laid:
    """laid with the batches of an epoch, plan: node, batch. One pass over the links for an epoch, after which each step reads its own only."""
    names, of = [], plan.select("node", "batch")

    def put(rows: DataFrame, label: str, keys: list[str]) -> DataFrame:
        names.append(f"{label}-{epoch}")
        return scratch.bucketed(rows.join(of, "node"), names[-1], keys, "batch")

    sizes = {k: put(v, f"sizes-{k}", ["node"]) for k, v in laid.sizes.items()}
    own = {k: put(v, f"own-{k}", ["node", "part"]) for k, v in laid.own.items()}
    far = {k: put(v, f"far-{k}", ["nbr", "slice"]) for k, v in laid.far.items()}
    return replace(laid, sizes=sizes, own=own, far=far, names=tuple(names))


def messages(laid: Laid, name: str, here: DataFrame, there: DataFrame, n: int, cfg, epoch: int, batch: int | None = None) -> DataFrame:
    """What the nodes of a vector need to move: node, part, y, key, n12, n21, nbr, parts, cnt, z.

    y is 1 for a link and 0 for a negative, z then the far end's place and n12 and n21 the normalisers of the pair as an edge and as the
    opposite edge; y is -1 for the node itself, once in each part. here and there: node, z of the vector and of the far ends'. A masked
    node's one link and its negative make one part. parts: of the node in this epoch; cnt: by which its sums are divided.
    """
    kinds, (drawn, drawn_key) = VECTORS[laid.variant][name]
    of = lambda d: d if batch is None else d.filter(F.col("batch") == batch)
    keep, row = kept(cfg, epoch), ["nbr", "slice", "a1", "a2"]
    ends = laid.about.join(there, "node").select(F.col("node").alias("nbr"), "idx", F.col("d1").alias("b1"), F.col("d2").alias("b2"), "z")
    norm = lambda x, y: F.log((F.col(x) + 1.0) * (F.col(y) + 1.0))

    def met(rows: DataFrame, key: str, y: int) -> DataFrame:
        part = F.when(F.col("parts") == 1, 0).otherwise(F.pmod(F.xxhash64("nbr", F.lit(key)), F.col("parts"))).cast("int")
        return rows.select("node", part.alias("part"), F.lit(y).alias("y"), F.lit(key).alias("key"), norm("a1", "b2").alias("n12"), norm("b1", "a2").alias("n21"), "nbr", "parts", "cnt", "z")

    def one(kind: str) -> DataFrame:
        first = F.min_by(F.struct(*row), draw(cfg.seed, "one", kind, epoch, F.col("node"), F.col("nbr")))
        picked = of(laid.own[kind]).filter(~keep).groupBy("node").agg(first.alias("r")).select("node", "r.*")
        return picked.withColumn("cnt", F.lit(1).cast("bigint")).withColumn("parts", F.lit(1))

    every = []
    for kind, key in kinds.items():
        spread = ends.join(laid.spread[kind].withColumnRenamed("node", "nbr"), "nbr").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        every.append(met(of(laid.far[kind]).filter(keep).join(spread, ["nbr", "slice"]), key, 1))
        every.append(met(one(kind).drop("slice").join(ends, "nbr"), key, 1))
    at = (draw(cfg.seed, "neg", drawn, epoch, F.col("node"), F.col("nbr")) % n).alias("idx")
    some = [d.select("node", at, "a1", "a2", "cnt", "parts") for d in (of(laid.own[drawn]).filter(keep), one(drawn))]
    every.append(met(some[0].unionByName(some[1]).join(ends, "idx"), drawn_key, 0))
    size = of(laid.sizes[name]).select("node", F.when(keep, F.col("parts")).otherwise(1).alias("parts"), F.when(keep, F.col("cnt")).otherwise(1).cast("bigint").alias("cnt"))
    own = size.join(here, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    nothing = {"y": F.lit(-1), "key": F.lit(None).cast("string"), "n12": F.lit(None).cast("double"), "n21": F.lit(None).cast("double"), "nbr": F.lit(None).cast("bigint")}
    own = own.select("node", "part", *[v.alias(k) for k, v in nothing.items()], "parts", "cnt", "z")
    return reduce(DataFrame.unionByName, every, own)
