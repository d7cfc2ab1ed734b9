"""Edge tables have columns src and dst (BIGINT). Everything here is an aggregation or an equi-join on node ids."""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw
from ..scratch import Scratch, broadcast_if_small
from . import dense, gaps
from .order import numbered, prefix_sums, smallest, tasks_for

log = logging.getLogger(__name__)


def directed(edges: DataFrame) -> DataFrame:
    """Distinct ordered pairs; loops stay."""
    return edges.select("src", "dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs, smaller id first; loops stay."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def nodes(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("src").alias("node")).distinct()


def node_map(edges: DataFrame) -> DataFrame:
    """node, idx: ids compacted in ascending order."""
    return numbered(nodes(edges), ["node"], "idx")


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with compacted ids; an end that ids (node, idx) doesn't have becomes -1."""
    a, b = (ids.select(F.col("node").alias(end), F.col("idx").alias(f"{end}_idx")) for end in ("src", "dst"))
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return out.select(*[F.coalesce(f"{end}_idx", F.lit(-1)).alias(end) for end in ("src", "dst")], *rest)


def unseen_nodes(edges: DataFrame, known: DataFrame) -> DataFrame:
    """node: ends of edges that known (node) doesn't have."""
    return nodes(edges).join(known.select("node"), "node", "left_anti")


def check_contained(test_pos: DataFrame, test_neg: DataFrame, known: DataFrame) -> None:
    """Raise if positives or negatives have nodes beyond the known ones."""
    for name, part in (("positive", test_pos), ("negative", test_neg)):
        n = unseen_nodes(part, known).count()
        if n:
            raise ValueError(f"{n} nodes of {name} test edges are not in train")


def check_edges(edges: DataFrame) -> DataFrame:
    """edges, if src and dst are there and are whole numbers."""
    types = dict(edges.dtypes)
    for end in ("src", "dst"):
        if types.get(end) not in ("bigint", "int", "smallint", "tinyint"):
            raise ValueError(f"an edge table needs a whole-number column {end}, not {types.get(end)}")
    return edges


def sorted_edges(edges: DataFrame) -> DataFrame:
    """src, dst, row: the edges' number in the order of both ends; equal edges get numbers in any order."""
    return numbered(edges.select("src", "dst"), ["src", "dst"], "row")


def valid_stub(train: DataFrame, n: int = 2) -> DataFrame:
    """The first train edges, as a stand-in for a validation part."""
    return train.select("src", "dst").orderBy("src", "dst").limit(n)


def gather_features(ids: DataFrame, features: DataFrame) -> DataFrame:
    """idx and the columns of features (node, ...) for the nodes of ids (node, idx); nodes without features get nulls."""
    return ids.join(features, "node", "left").drop("node")


def degree(edges: DataFrame) -> DataFrame:
    """Undirected degree of each node; a loop counts 2."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def degree_out_in(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_distinct(edges: DataFrame) -> DataFrame:
    """Number of distinct neighbours in either direction."""
    return degree_of_sets(both_ways(edges).distinct())


def degree_of_sets(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def degree_total(edges: DataFrame) -> DataFrame:
    """Out-degree plus in-degree: reciprocal edges count twice."""
    return degree(edges)


def active_nodes(all_nodes: DataFrame, deg: DataFrame) -> DataFrame:
    """node: those of all_nodes with an edge, by any of the degree columns of deg."""
    some = sum((F.col(c) for c in deg.columns if c != "node"), F.lit(0))
    return all_nodes.join(deg.filter(some > 0), "node", "left_semi").select("node")


def adjacency(edges: DataFrame) -> DataFrame:
    """Long form: node, nbr, distinct. Long rows keep hubs spread over partitions; collect them only where degrees are bounded."""
    return both_ways(edges).distinct().select(F.col("src").alias("node"), F.col("dst").alias("nbr"))


#: Neighbours in a block of adjacency_blocks.
HUB = 4096


def adjacency_blocks(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """node, offset, n, first, deltas: the compressed form of adjacency, a node's sorted neighbours as the first one and steps.

    offset: number of neighbours of all nodes before, and of the node's own before the block, so the smallest of a node is where its
    neighbours start in one long array of all. A hub's neighbours are cut wherever that array passes a multiple of `hub`, so no block
    holds more, and blocks come from one order over all rows without a task that holds a node's.
    """
    pairs = Scratch(edges.sparkSession, "adjacency").save(adjacency(edges), "pairs")
    n = pairs.count()
    rows = numbered(pairs, ["node", "nbr"], "row", n).withColumn("cut", F.floor(F.col("row") / hub)).repartition(tasks_for(edges.sparkSession, n), "node", "cut")
    per = rows.groupBy("node", "cut").agg(F.min("row").alias("offset"), F.sort_array(F.collect_list("nbr")).alias("nbrs"))  # hub at most
    steps = F.zip_with(F.slice("nbrs", 2, hub), F.slice("nbrs", 1, F.size("nbrs") - 1), lambda a, b: a - b)
    return per.select("node", "offset", F.size("nbrs").cast("bigint").alias("n"), F.col("nbrs")[0].alias("first"), steps.alias("deltas"))


def row_pointers(blocks: DataFrame) -> DataFrame:
    """node, start, n: where a node's neighbours are in the array of all, and how many."""
    return blocks.groupBy("node").agg(F.min("offset").alias("start"), F.sum("n").alias("n"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """The long form (node, nbr) of adjacency_blocks."""
    steps = blocks.select("node", "offset", F.posexplode(F.concat(F.array("first"), "deltas")).alias("i", "step"))
    upto = Window.partitionBy("node", "offset").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("node", F.sum("step").over(upto).alias("nbr"))


def temporal_pairs(edges: DataFrame, how: str) -> DataFrame:
    """One time per ordered pair: min, median or max."""
    if how not in ("min", "median", "max"):
        raise ValueError(f"min, median or max, not {how}")
    return edges.groupBy("src", "dst").agg(getattr(F, how)("t").cast("double").alias("t"))


def temporal_thresholds(timed: DataFrame, ratios: list[float]) -> DataFrame:
    """ratio, threshold: the (floor(n r))-th smallest time, at least the first, from counts per distinct time; a time is null if rows with
    null times reach that far. Running sums go by ranges of times, so fine-grained times are no work of one task.
    """
    per = timed.groupBy("t").agg(F.count("*").alias("c"))
    run = prefix_sums(per, ["t"], {"before": F.col("c")}).select("t", (F.col("before") + F.col("c")).alias("upto"))
    n = timed.agg(F.count("*").alias("n"))
    wanted = timed.sparkSession.createDataFrame([(r,) for r in ratios], "ratio double").crossJoin(F.broadcast(n)).select("ratio", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("ratio"))).alias("k"))  # one row of counts
    return run.join(F.broadcast(wanted), F.col("upto") >= F.col("k")).groupBy("ratio").agg(F.min_by("t", "upto").alias("threshold"))


def temporal_split(timed: DataFrame, threshold: float) -> DataFrame:
    return timed.withColumn("part", F.when(F.col("t") < threshold, "train").otherwise("test"))


def temporal_split_at(timed: DataFrame, ratio: float) -> DataFrame:
    """temporal_split at the threshold of a ratio."""
    at = temporal_thresholds(timed, [ratio]).select("threshold")
    both = timed.crossJoin(F.broadcast(at))  # one row
    return both.select(*timed.columns, F.when(F.col("t") < F.col("threshold"), "train").otherwise("test").alias("part"))


def random_split(edges: DataFrame, ratio: float, seed: int = 1, rounding: str = "round") -> DataFrame:
    """src, dst, part: exactly round(n r) (half to even) or floor(n r) edges are train, those with the smallest draws.

    The cut is found by counting draws in 4096 ranges, then in 4096 ranges of the one that holds it, until that is small. Equal edges
    share their draw and end up in one part.
    """
    e = edges.select("src", "dst").withColumn("r", draw(seed, F.col("src"), F.col("dst")))
    e = Scratch(edges.sparkSession, "split").save(e, "draws")
    want, prefix, shift = None, 0, 0
    for shift in (40, 28, 16, 4):
        inside = e.filter(F.shiftright("r", shift + 12) == prefix)
        counts = {r["bin"]: r["count"] for r in inside.groupBy((F.shiftright("r", shift) % 4096).alias("bin")).count().collect()}  # at most 4096 rows
        if want is None:
            n = sum(counts.values())
            want = int(round(n * ratio)) if rounding == "round" else int(n * ratio)
            if want >= n:
                return e.select("src", "dst", F.lit("train").alias("part"))
        cut = 0
        while want >= counts.get(cut, 0):
            want -= counts.get(cut, 0)
            cut += 1
        prefix = prefix << 12 | cut
        if counts[cut] <= 4096:
            break
    train = F.shiftright("r", shift) < prefix
    if want:
        order = F.struct("r", "src", "dst")
        last = e.filter(F.shiftright("r", shift) == prefix).orderBy("r", "src", "dst").limit(want).agg(F.max(order).alias("m")).first()["m"]
        train = train | ((F.shiftright("r", shift) == prefix) & (order <= F.struct(*[F.lit(x).cast("bigint") for x in last])))
    return e.select("src", "dst", F.when(train, "train").otherwise("test").alias("part"))


def split_stats(split: DataFrame) -> DataFrame:
    """One row for a table with part: edges of train and test, their ratio, distinct train nodes and train edges per node."""
    per = split.groupBy().agg(F.sum((F.col("part") == "train").cast("bigint")).alias("n_train"), F.sum((F.col("part") == "test").cast("bigint")).alias("n_test"))
    count = nodes(split.filter("part = 'train'")).agg(F.count("*").alias("n_nodes"))
    both = per.crossJoin(F.broadcast(count))  # one row each
    return both.select("n_train", "n_test", "n_nodes", F.round(F.col("n_test") / F.col("n_train").cast("double"), 9).alias("test_per_train"), F.round(F.col("n_train") / F.col("n_nodes").cast("double"), 9).alias("edges_per_node"))


def transductive(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test edges with both ends in train."""
    known = nodes(train)
    out = test.join(known.withColumnRenamed("node", "src"), "src", "left_semi")
    return out.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def draws_for(want: int, free: int, cells: float) -> int:
    """So many uniform draws among cells find `want` of the free ones, as good as always; a little more than the expected number."""
    need = -cells * math.log1p(-min(want / free, 1 - 0.5 / free))
    return int(need * 1.01 + 6 * math.sqrt(need)) + 16


def negatives(edges: DataFrame, num: int, seed: int = 1, strict: bool = True, oversample: float = 2.0, loops: bool = False, pool: DataFrame | None = None) -> DataFrame:
    """src, dst: num distinct pairs of known nodes that are no edges; strict also rejects the other orientation and loops.

    Not strict, ordered pairs count apart, and loops are rejected unless asked for. Ends are drawn from the nodes of pool (of edges by
    default). Draws come from counters, as many as it takes, up to 64 times oversample times num; where many of all pairs are wanted, the
    pairs that they hit are kept as bits (operators.dense). What they leave wanting is taken
    from the gaps between the neighbours of each node, one pair from each of as many strata of all pairs that are still free. Free pairs
    are counted first: fewer come back only if no more are free, and where all are wanted none are drawn.
    """
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "negatives")
    ids = scratch.save(node_map(edges if pool is None else pool), "ids")
    n = ids.count()
    taken = scratch.save(undirected(edges) if strict else directed(edges), "taken")
    if not n or num <= 0:
        return taken.limit(0)
    loose = loops and not strict
    cells, pairs = (n * n / 2, n * (n - 1) // 2) if strict else (n * n, n * n if loops else n * (n - 1))
    barred = taken if loose else taken.filter("src <> dst")
    free = pairs - barred.count()
    if free <= num or pool is not None and dense.window(num, free, cells, 5):
        if pool is not None:  # only pairs within the pool count
            for end in ("src", "dst"):
                barred = barred.join(ids.select(F.col("node").alias(end)), end, "left_semi")
            free = pairs - barred.count()
        if free <= num:
            if free < num:
                log.warning("%d of %d negatives found: no more are free", free, num)
            return dense.listed(dense.all_free(_numbers(taken, ids, n), ids, n, strict, loose))
    most = 64 * (int(num * oversample) + 16)
    width, numbers = 5, _numbers(taken, ids, n)
    while (around := dense.window(num, free, cells, width)) and around[1] <= most:
        hits = dense.first_hits(scratch, numbers, ids, n, seed, *around, strict, loose)
        found, late = hits.agg(F.sum("n"), F.sum(F.size("late"))).first()
        if found <= num <= found + late:
            after = scratch.save(hits.select(F.explode("late").alias("h")).select("h.*"), f"late-{width}")
            return dense.listed(hits).unionByName(smallest(after, "id", num - found).select("src", "dst"))
        width *= 2
    k, turn = min(most, draws_for(num, free, cells)), 0
    while True:
        c = spark.range(k).select("id", (draw(seed, "x", F.col("id")) % n).alias("i"), (draw(seed, "y", F.col("id")) % n).alias("j"))
        c = c if loose else c.filter("i <> j")
        c = c.join(ids.select(F.col("idx").alias("i"), F.col("node").alias("a")), "i").join(ids.select(F.col("idx").alias("j"), F.col("node").alias("b")), "j")
        src, dst = (F.least("a", "b"), F.greatest("a", "b")) if strict else (F.col("a"), F.col("b"))
        c = c.select("id", src.alias("src"), dst.alias("dst")).groupBy("src", "dst").agg(F.min("id").alias("id")).join(taken, ["src", "dst"], "left_anti")
        c = scratch.save(c, f"free-{turn}")
        found = c.count()
        if found >= num:
            return smallest(c, "id", num).select("src", "dst")
        if k == most:
            break
        k, turn = min(most, 2 * k), turn + 1
    c = c.select("src", "dst")
    runs = scratch.save(free_runs(ids, n, taken.unionByName(c), strict, loops), "left")
    left, wanted = runs.agg(F.sum("len")).first()[0], num - found
    log.info("%d of %d negatives were drawn, %d are ranks of %d pairs", found, num, wanted, left)
    ranks = spark.range(wanted).select(gaps.strata(F.col("id"), F.lit(left), F.lit(wanted), seed, "rank", F.col("id")).alias("r"))
    return c.unionByName(_named(gaps.ranked(runs, ranks), ids))


def free_runs(ids: DataFrame, n: int, taken: DataFrame, strict: bool = True, loops: bool = False) -> DataFrame:
    """i, start, len: the gaps between the neighbours of each node of ids (node, idx of n), by idx; strict: pairs once, smaller idx first."""
    low = F.col("idx") + 1 if strict else F.lit(0)
    sources = ids.select(F.col("idx").alias("i"), low.cast("bigint").alias("low"))
    rows = _numbers(taken, ids, n)
    rows = rows.select(F.least("i", "x").alias("i"), F.greatest("i", "x").alias("x")) if strict else rows.select("i", "x")
    if not strict and not loops:
        rows = rows.unionByName(sources.select("i", F.col("i").alias("x")))
    return gaps.gaps(rows, sources, n)


def _numbers(pairs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """i, x: idx (of n) of the nodes of pairs (src, dst); pairs of other nodes are left out."""
    a, b = (broadcast_if_small(ids.select(F.col("node").alias(end), F.col("idx").alias(to)), n, 16) for end, to in (("src", "i"), ("dst", "x")))
    return pairs.select("src", "dst").join(a, "src").join(b, "dst").select("i", "x")


def _named(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """src, dst: nodes of pairs of idx (i, x)."""
    a, b = (ids.select(F.col("node").alias(end), F.col("idx").alias(of)) for end, of in (("src", "i"), ("dst", "x")))
    return pairs.join(a, "i").join(b, "x").select("src", "dst")


def negatives_for(train: DataFrame, test: DataFrame, ratio: float = 5, seed: int = 1, strict: bool = True) -> DataFrame:
    """As many negatives as ratio times the test edges, among train nodes, that are in neither part."""
    return negatives(train.select("src", "dst").unionByName(test.select("src", "dst")), int(test.count() * ratio), seed, strict, pool=train)


def negatives_per_node(edges: DataFrame, sources: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """src, dst, row: for each of the sources (node) its first k of 4 k draws that are no edges, loops or repeats, in the order of both ends.

    A source that lacks so few neighbours that draws don't find k gets the rest from the gaps between its neighbours, one of each of as
    many strata; one that lacks fewer than k gets all of them.
    """
    scratch = Scratch(edges.sparkSession, "per-node")
    ids = scratch.save(node_map(edges), "ids")
    n = ids.count()
    c = sources.select(F.col("node").alias("src")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4 * k - 1))))
    c = c.withColumn("idx", draw(seed, "pn", F.col("src"), F.col("i")) % n).join(ids.withColumnRenamed("node", "dst"), "idx").filter("src <> dst")
    c = c.groupBy("src", "dst").agg(F.min("i").alias("i")).join(directed(edges), ["src", "dst"], "left_anti")
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("i"))).filter(F.col("nth") <= k)
    c = scratch.save(c.select("src", "dst"), "drawn")
    per = c.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("has"))
    short = sources.select("node").distinct().join(per, "node", "left").select("node", (F.lit(k) - F.coalesce("has", F.lit(0))).alias("wanted")).filter("wanted > 0")
    short = scratch.save(short.join(ids, "node").select("node", F.col("idx").alias("i"), "wanted"), "short")
    if short.limit(1).count():
        known = edges.select("src", "dst").unionByName(c).join(short.select(F.col("node").alias("src"), "i"), "src").join(ids.select(F.col("node").alias("dst"), F.col("idx").alias("x")), "dst")
        known = known.select("i", "x").unionByName(short.select("i", F.col("i").alias("x")))
        runs = scratch.save(gaps.gaps(known, short.select("i", F.lit(0).cast("bigint").alias("low")), n), "runs")
        free = runs.groupBy("i").agg(F.sum("len").alias("free"))
        ranks = short.join(free, "i").withColumn("wanted", F.least("wanted", "free")).withColumn("j", F.explode(F.expr("sequence(0L, wanted - 1L)")))
        ranks = ranks.select("i", gaps.strata(F.col("j"), F.col("free"), F.col("wanted"), seed, "rank", F.col("node"), F.col("j")).alias("r"))
        c = c.unionByName(_named(gaps.ranked(runs, ranks, within=True), ids))
    return sorted_edges(c)


def contract(pos: DataFrame, neg: DataFrame, test_deg: DataFrame, k: int) -> DataFrame:
    """One row for rows (src, dst, row): whether there are k negatives for each active source, each source has just k in ascending
    blocks, positives are sorted, and test_deg (node, test_degree) counts the positives of each source."""

    def unsorted(rows: DataFrame, key: Column) -> DataFrame:
        a, b = rows.select("row", key.alias("k")), rows.select((F.col("row") - 1).alias("row"), key.alias("following"))
        return a.join(b, "row").agg(F.count(F.when(F.col("k") > F.col("following"), 1)).alias("bad"))

    per_pos = pos.groupBy("src").agg(F.count("*").alias("p"))
    per_neg = neg.groupBy("src").agg(F.count("*").alias("q"))
    deg = test_deg.filter("test_degree > 0").select(F.col("node").alias("src"), F.col("test_degree").alias("d"))
    j = per_pos.join(per_neg, "src", "full").join(deg, "src", "full")
    per = j.agg(F.sum(F.coalesce("q", F.lit(0))).alias("negs"), F.count("p").alias("active"), F.count(F.when(F.col("p").isNotNull() & ~F.col("q").eqNullSafe(F.lit(k)), 1)).alias("uneven"), F.count(F.when(~F.col("p").eqNullSafe(F.col("d")), 1)).alias("off"))
    out = per.crossJoin(unsorted(neg, F.col("src")).withColumnRenamed("bad", "bad_neg")).crossJoin(unsorted(pos, F.struct("src", "dst")).withColumnRenamed("bad", "bad_pos"))  # one row each
    return out.select((F.col("negs") == F.col("active") * k).alias("sizes"), ((F.col("uneven") == 0) & (F.col("bad_neg") == 0)).alias("blocks"), (F.col("bad_pos") == 0).alias("positives_sorted"), (F.col("off") == 0).alias("degrees"))


def directed_split(edges: DataFrame, ratio: float, neg_ratio: float = 5, seed: int = 1) -> dict[str, DataFrame]:
    """train, test_pos, test_neg of ordered pairs: random split, transductive filter, ordered negatives."""
    scratch = Scratch(edges.sparkSession, "directed-split")
    s = scratch.save(random_split(directed(edges), ratio, seed), "split")
    train = s.filter("part = 'train'").select("src", "dst")
    test = scratch.save(transductive(s.filter("part = 'test'"), train), "test")
    return {"train": train, "test_pos": test, "test_neg": negatives_for(train, test, neg_ratio, seed, strict=False)}


def test_degree(all_nodes: DataFrame, test: DataFrame) -> DataFrame:
    per = test.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("c"))
    return all_nodes.join(per, "node", "left").select("node", F.coalesce("c", F.lit(0)).cast("bigint").alias("test_degree"))
