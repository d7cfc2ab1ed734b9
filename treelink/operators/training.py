"""Coordinate training: each node moves to the candidate coordinates that lose least against its neighbours and sampled negatives.

Three variants: "undir" (one vector, undirected), "sr" (one vector, directed) and "dr" (a head and a tail vector). Links, samples and
losses are relational; only the sums over candidates are numpy, in tasks that hold a bounded number of links.
"""

from __future__ import annotations

import dataclasses
import json
import logging
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import draw, link_probability, log_loss, pair_distance, selected
from ..scratch import Scratch, delete_path, read_file, temporary, write_text
from . import graph as g
from . import moves
from .layout import Laid, in_batches, kept, lay, messages
from .metrics import ranking_metrics
from .order import next_fit, prefix_sums

log = logging.getLogger(__name__)
#: Links of a node that one task sums; the sums of larger nodes are added up afterwards.
HUB = 4096


@dataclass(frozen=True)
class TrainConfig:
    """height: bits of a coordinate; dims: coordinates per node; c: candidates per level and height; weight: of the positive loss.

    convergence: share of the epochs in which nodes are masked; mask_share: share of nodes that keep all their links then; oi: for
    "dr", 1 takes out- and in-degrees, 0 the total; eval_step: epochs between evaluations; edge_cap: links per synchronous batch (None:
    all), more on tables that would make more than max_batches of them, as each batch is a Spark job or more; portable: candidates from
    MD5 counters, which SQL can repeat, instead of a faster generator.
    """

    height: int = 12
    dims: int = 16
    c: float = 1.0
    alpha: float = 8.0
    gamma: float = 3.0
    weight: float = 1.0
    eps: float = 1e-5
    epochs: int = 10
    mask_share: float = 0.8
    seed: int = 1
    convergence: float = 0.8
    oi: int = 1
    eval_step: int = 10
    edge_cap: int | None = None
    max_batches: int = 64
    portable: bool = False

    @property
    def per_level(self) -> int:
        return max(1, int(self.c * self.height))

    @property
    def candidates(self) -> int:
        return self.height * self.per_level + 1


#: Defaults of the three variants.
DEFAULTS = {
    "undir": TrainConfig(height=17, c=1, alpha=24.0, gamma=3.0, epochs=50, seed=0, edge_cap=512),
    "sr": TrainConfig(height=15, c=2, alpha=3.0, gamma=3.0, epochs=200, seed=0, eval_step=10, edge_cap=128),
    "dr": TrainConfig(height=12, c=1, alpha=3.0, gamma=3.0, epochs=50, seed=0, eval_step=1, edge_cap=256),
}


def init_coordinates(nodes: DataFrame, cfg: TrainConfig, name: str = "z") -> DataFrame:
    """node, z: uniform coordinates from counters."""
    z = F.array(*[draw(cfg.seed, name, F.col("node"), t) % (1 << cfg.height) for t in range(cfg.dims)])
    return nodes.select("node", z.alias("z"))


def score_pairs(pairs: DataFrame, loc: DataFrame, deg: DataFrame, cfg: TrainConfig, tail: DataFrame | None = None) -> DataFrame:
    """pairs with score. deg: node, d1 (as source), d2 (as target); tail: coordinates of targets where they differ from loc. Pairs with a node that has no coordinates go; see dropped_pairs."""
    a = loc.join(deg, "node", "left").select(F.col("node").alias("src"), F.col("z").alias("z1"), F.coalesce("d1", F.lit(0)).alias("d1"))
    b = (tail or loc).join(deg, "node", "left").select(F.col("node").alias("dst"), F.col("z").alias("z2"), F.coalesce("d2", F.lit(0)).alias("d2"))
    j = pairs.join(a, "src").join(b, "dst")
    return j.withColumn("score", link_probability(pair_distance(F.col("z1"), F.col("z2"), cfg.dims), F.col("d1"), F.col("d2"), cfg.alpha, cfg.gamma, cfg.eps)).drop("z1", "z2", "d1", "d2")


def dropped_pairs(pairs: DataFrame, loc: DataFrame, tail: DataFrame | None = None) -> int:
    """Number of pairs that score_pairs can't score."""
    known = lambda of, end: of.select(F.col("node").alias(end))
    return pairs.count() - pairs.join(known(loc, "src"), "src", "left_semi").join(known(tail or loc, "dst"), "dst", "left_semi").count()


def degrees_for(edges: DataFrame, directed: bool, oi: int = 1) -> DataFrame:
    """node, d1, d2: degrees that stand for a node as source and as target."""
    if directed and oi:
        return g.degree_out_in(edges).select("node", F.col("out_degree").alias("d1"), F.col("in_degree").alias("d2"))
    return g.degree(edges).select("node", F.col("degree").alias("d1"), F.col("degree").alias("d2"))


def links_of(edges: DataFrame, variant: str) -> dict[str, DataFrame]:
    """Links (node, nbr) that a variant trains on, by the kind of link."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct()
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr")).distinct()
    kinds = {"undir": ("all",), "sr": ("all", "out", "in"), "dr": ("out", "in")}
    if variant not in kinds:
        raise ValueError(f"undir, sr or dr, not {variant}")
    made = {"all": g.adjacency(edges), "out": out, "in": back}
    return {k: made[k] for k in kinds[variant]}


def choice_mask(nodes: DataFrame, cfg: TrainConfig, epoch: int) -> DataFrame:
    """node, keep: whether the node uses all its links in this epoch."""
    return nodes.select("node", kept(cfg, epoch).alias("keep"))


def by_rows(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt by keys to so many tasks, as joins and sums by them then use, if a number is given."""
    return df.repartition(tasks, *keys) if tasks else df


def neighbour_sample(links: DataFrame, cfg: TrainConfig, epoch: int, kind: str = "all") -> DataFrame:
    """node, nbr: all links of a node that keeps them, one uniform link of any other."""
    one = links.groupBy("node").agg(F.min_by("nbr", draw(cfg.seed, "one", kind, epoch, F.col("node"), F.col("nbr"))).alias("only"))
    return links.join(one, "node").filter(kept(cfg, epoch) | (F.col("nbr") == F.col("only"))).select("node", "nbr")


def drawn_negatives(used: DataFrame, ids: DataFrame, n: int, cfg: TrainConfig, epoch: int, kind: str = "all", tasks: int | None = None) -> DataFrame:
    """node, nbr: a uniform node for each used link, neighbours and the node itself included. ids: node, idx."""
    at = used.select("node", (draw(cfg.seed, "neg", kind, epoch, F.col("node"), F.col("nbr")) % n).alias("idx"))
    return by_rows(at, tasks, "idx").join(ids.select("idx", F.col("node").alias("nbr")), "idx").select("node", "nbr")


def candidates(loc: DataFrame, cfg: TrainConfig, epoch: int, name: str = "z") -> DataFrame:
    """node, t, l, cand: for each coordinate all flips of bit i with random bits below it, per_level of each, and itself as the last."""
    k, last = cfg.per_level, cfg.candidates - 1
    rows = loc.select("node", F.posexplode("z").alias("t", "z")).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(last))))
    level = (F.col("l") / k).cast("int")
    flip = F.call_function("shiftleft", F.expr("1L"), level)
    mask = draw(cfg.seed, "m", name, epoch, F.col("node"), F.col("l"), F.col("t")) % flip
    return rows.select("node", "t", "l", F.when(F.col("l") == last, F.col("z")).otherwise(F.col("z").bitwiseXOR(flip).bitwiseXOR(mask)).alias("cand"))


def batch_assign(nodes: DataFrame, links: DataFrame, cfg: TrainConfig, epoch: int, cap: int) -> DataFrame:
    """node, cost, batch: nodes with links in a random order, cut where the running sum of their costs passes a multiple of cap.

    A cost is the number of links, or 1 for a masked node. A batch holds less than cap plus its last node's cost; packing them to the
    brim one after the other would need one task for all nodes.
    """
    per = links.groupBy("node").agg(F.count("*").alias("links"))
    cost = nodes.select("node").join(per, "node").select("node", F.when(kept(cfg, epoch), F.col("links")).otherwise(F.lit(1)).cast("bigint").alias("cost"))
    run = prefix_sums(cost.withColumn("r", draw(cfg.seed, "batch", epoch, F.col("node"))), ["r", "node"], {"before": F.col("cost")})
    return run.select("node", "cost", F.floor(F.col("before") / cap).cast("bigint").alias("batch"))


def batch_costs(links: dict[str, DataFrame], cfg: TrainConfig, epoch: int) -> DataFrame:
    """node, cost: the links that a node's step looks at, of all kinds of its variant; of a masked node one of each kind that it has."""
    kinds = None
    for kind, rows in links.items():
        rows = rows.select("node", F.lit(kind).alias("kind"))
        kinds = rows if kinds is None else kinds.unionByName(rows)
    per = kinds.groupBy("node", "kind").agg(F.count("*").alias("n"))
    return per.groupBy("node").agg(F.sum(F.when(kept(cfg, epoch), F.col("n")).otherwise(F.lit(1))).cast("bigint").alias("cost"))


def batch_pack(links: dict[str, DataFrame], cfg: TrainConfig, epoch: int, cap: int) -> DataFrame:
    """node, cost, batch: nodes with links in a random order, packed one after the other into batches of cap links at most; a node of more is a batch by itself."""
    cost = batch_costs(links, cfg, epoch).withColumn("r", draw(cfg.seed, "batch", epoch, F.col("node")))
    return next_fit(cost, ["r", "node"], "cost", cap, "batch").select("node", "cost", "batch")


def branches(links: dict[str, DataFrame], ids: DataFrame, n: int, cfg: TrainConfig, epoch: int, variant: str, tasks: int | None = None) -> dict[str, DataFrame]:
    """For each vector that moves (z, or head and tail): node, nbr, key (of SELECTORS), y (1 link, 0 negative), cnt (by which the node's sums are divided).

    tasks: as many as the links need (tasks_for), so that tasks grow in number and not in size.
    """
    used = {k: neighbour_sample(by_rows(v, tasks, "node"), cfg, epoch, k) for k, v in links.items()}
    count = lambda k: used[k].groupBy("node").agg(F.count("*").alias("cnt"))
    row = lambda d, key, y: d.select("node", "nbr", F.lit(key).alias("key"), F.lit(y).alias("y"))
    drawn = lambda k: drawn_negatives(used[k], ids, n, cfg, epoch, k, tasks)
    if variant == "undir":
        return {"z": row(used["all"], "out", 1).unionByName(row(drawn("all"), "not_out", 0)).transform(by_rows, tasks, "node").join(count("all"), "node")}
    if variant == "sr":
        rows = row(used["out"], "out", 1).unionByName(row(used["in"], "in", 1)).unionByName(row(drawn("all"), "neither", 0))
        return {"z": by_rows(rows, tasks, "node").join(count("all"), "node")}
    out = row(used["out"], "out", 1).unionByName(row(drawn("out"), "not_out", 0)).transform(by_rows, tasks, "node").join(count("out"), "node")
    back = row(used["in"], "in", 1).unionByName(row(drawn("in"), "not_in", 0)).transform(by_rows, tasks, "node").join(count("in"), "node")
    return {"head": out, "tail": back}


def with_ends(rows: DataFrame, own: DataFrame, other: DataFrame, deg: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows with z1 of node, z2 of nbr and the normalisers n12 and n21 of the pair as an edge and as the opposite edge."""
    a = own.join(deg, "node", "left").select("node", F.col("z").alias("z1"), F.coalesce("d1", F.lit(0)).alias("a1"), F.coalesce("d2", F.lit(0)).alias("a2"))
    b = other.join(deg, "node", "left").select(F.col("node").alias("nbr"), F.col("z").alias("z2"), F.coalesce("d1", F.lit(0)).alias("b1"), F.coalesce("d2", F.lit(0)).alias("b2"))
    norm = lambda x, y: F.log((F.col(x) + 1.0) * (F.col(y) + 1.0))
    met = by_rows(by_rows(rows, tasks, "nbr").join(b, "nbr"), tasks, "node")
    return met.join(a, "node").withColumn("n12", norm("a1", "b2")).withColumn("n21", norm("b1", "a2"))


def losses(rows: DataFrame, cfg: TrainConfig) -> DataFrame:
    """node, pos, neg: a node's mean losses where it stands, for rows of with_ends."""
    from_norm = lambda n: F.when(F.col(n) > 0, F.lit(1.0) / (F.lit(1.0) + F.pow((pair_distance(F.col("z1"), F.col("z2"), cfg.dims) + F.lit(cfg.eps)) / F.col(n), F.lit(float(cfg.gamma))) / F.lit(float(cfg.alpha)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("p12", from_norm("n12")).withColumn("p21", from_norm("n21"))
    p = F.lit(None).cast("double")
    for key in ("out", "in", "not_out", "not_in", "neither"):
        p = F.when(F.col("key") == key, selected(key, F.col("p12"), F.col("p21"))).otherwise(p)
    cost = log_loss(p, cfg.eps) / F.col("cnt")
    return rows.groupBy("node").agg(F.sum(F.when(F.col("y") == 1, cost).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, cost).otherwise(0.0)).alias("neg"))


MOVED = "node long, z array<long>, loss double, pos double, neg double"
_SUMMED = MOVED + ", cnt long, sums array<double>"


def packed(z: str, height: int, dims: int) -> Column:
    """Coordinates below 2^16 four to a number, as they are sent to the nodes that move; larger ones as they are."""
    if height > 16:
        return F.col(z)
    word = lambda i: reduce(Column.bitwiseOR, [F.shiftleft(F.col(z)[j], 16 * (j - i)) for j in range(i, min(i + 4, dims))])
    return F.array(*[word(i) for i in range(0, dims, 4)])


def unpacked(column: pa.ChunkedArray, height: int, dims: int) -> np.ndarray:
    """Rows of what packed() gives."""
    rows = np.asarray(column.combine_chunks().flatten())
    return rows.reshape(-1, dims) if height > 16 else rows.astype("<i8").view("<u2").reshape(-1, -(-dims // 4) * 4)[:, :dims]


def _moved(node: np.ndarray, found: tuple, cnt: np.ndarray, sums: list | None = None) -> pa.RecordBatch:
    z, loss, pos, neg = found
    empty = pa.nulls(len(node), pa.float64())
    values = [pa.array(x) if x is not None else empty for x in (loss, pos, neg)]
    places = pa.ListArray.from_arrays(np.arange(len(node) + 1, dtype=np.int32) * z.shape[1], pa.array(z.reshape(-1).astype(np.int64)))
    return pa.record_batch([pa.array(node), places, *values, pa.array(cnt), pa.array(sums, pa.list_(pa.float64())) if sums is not None else pa.nulls(len(node), pa.list_(pa.float64()))], names=["node", "z", "loss", "pos", "neg", "cnt", "sums"])


def _groups_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (node, part) groups, of a bounded number of links and nodes, from rows in their order."""
    left = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t])
        key = np.stack([np.asarray(t["node"]), np.asarray(t["part"])])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        at = 0
        for i, s in enumerate(starts):  # cut where a group starts and enough is before it
            if s > starts[at] and (s - starts[at] >= moves.LINKS or i - at >= moves.NODES):
                yield t.slice(starts[at], s - starts[at])
                at = i
        left = t.slice(starts[at])
    if left is not None and left.num_rows:
        yield left


def move(rows: DataFrame, cfg: TrainConfig, epoch: int, name: str = "z") -> DataFrame:
    """node, z (where it moves), loss, pos, neg for rows of messages. Links of large nodes are summed by parts, so no task holds a hub's."""
    rows = rows.withColumn("z", packed("z", cfg.height, cfg.dims)).repartition("node", "part").sortWithinPartitions("node", "part", "y", "key", "n12", "n21", "nbr")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups_at_a_time(batches):
            y, every = np.asarray(t["y"]).astype(np.int64), unpacked(t["z"], cfg.height, cfg.dims)
            own = y < 0  # the node itself, the first row of its group
            at, z, node = (np.cumsum(own) - 1)[~own], every[own], np.asarray(t["node"])[own]
            cnt, parts = np.asarray(t["cnt"])[own], np.asarray(t["parts"])[own]
            cand, rank = moves.candidates_of(node, z, cfg, epoch, name)
            sums = np.zeros((len(node), 2, cfg.candidates, cfg.dims))
            if len(at):
                link = t.filter(pa.array(~own))
                key = link["key"].combine_chunks().dictionary_encode()
                tables, row = moves.coded_tables(key.dictionary.to_pylist(), np.asarray(key.indices).astype(np.int64), np.asarray(link["n12"]), np.asarray(link["n21"]), cfg)
                sums = moves.level_sums(at, z, every[~own], y[~own], tables, row, cand, cfg.height)
            whole = parts == 1
            if whole.any():
                yield _moved(node[whole], moves.settle(z[whole], cand[whole], rank[whole], sums[whole], cnt[whole], cfg.weight), cnt[whole])
            if not whole.all():
                yield _moved(node[~whole], (z[~whole], None, None, None), cnt[~whole], [s.reshape(-1) for s in sums[~whole]])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        node, cnt, z = np.array(group["node"].iloc[:1]), np.array(group["cnt"].iloc[:1]), np.array([group["z"].iloc[0]], np.int64)
        sums = np.zeros(2 * cfg.candidates * cfg.dims)
        for part in group["sums"]:
            sums += np.asarray(part)
        cand, rank = moves.candidates_of(node, z, cfg, epoch, name)
        to, *losses = moves.settle(z, cand, rank, sums.reshape(1, 2, cfg.candidates, cfg.dims), cnt, cfg.weight)
        return pd.DataFrame([(int(node[0]), to[0].tolist(), *[float(x[0]) for x in losses])], columns=["node", "z", "loss", "pos", "neg"])

    parts = Scratch(rows.sparkSession, "moves").save(rows.mapInArrow(summed, _SUMMED), "parts")
    return parts.filter("sums is null").select("node", "z", "loss", "pos", "neg").unionByName(parts.filter("sums is not null").groupBy("node").applyInPandas(added, MOVED))


@dataclass(frozen=True)
class Model:
    """vectors: node, z by name (z, or head and tail); deg: node, d1, d2."""

    variant: str
    vectors: dict[str, DataFrame]
    deg: DataFrame
    cfg: TrainConfig

    def score(self, pairs: DataFrame) -> DataFrame:
        head = self.vectors.get("z", self.vectors.get("head"))
        return score_pairs(pairs, head, self.deg, self.cfg, self.vectors.get("tail"))


def start(edges: DataFrame, cfg: TrainConfig, variant: str) -> Model:
    """An untrained model of the nodes of edges (undirected or directed distinct pairs)."""
    names = ("head", "tail") if variant == "dr" else ("z",)
    nodes = g.nodes(edges)
    return Model(variant, {n: init_coordinates(nodes, cfg, n) for n in names}, degrees_for(edges, variant != "undir", cfg.oi if variant == "dr" else 1), cfg)


def step(model: Model, links: dict[str, DataFrame] | Laid, ids: DataFrame, n: int, epoch: int, batch: int | None = None) -> dict[str, DataFrame]:
    """One synchronous step: by vector, node, z, loss, pos, neg of the nodes that had links. batch: of links laid by batch, the nodes that move."""
    laid = links if isinstance(links, Laid) else lay(links, ids, model.deg, model.variant, HUB)
    opposite = {"z": "z", "head": "tail", "tail": "head"}
    return {name: move(messages(laid, name, model.vectors[name], model.vectors[opposite[name]], n, model.cfg, epoch, batch), model.cfg, epoch, name) for name in model.vectors}


class Progress:
    """Coordinates after each epoch in a folder, and a manifest that is written last, from which a lost run goes on.

    The manifest names the epoch and holds the history and what the run is of; the epoch before the last stays until it is written.
    """

    def __init__(self, spark: SparkSession, path: str, run: dict):
        self.spark, self.path, self.run = spark, path, run

    def found(self) -> dict | None:
        """The last manifest, if it is of the same run."""
        text = read_file(self.spark, f"{self.path}/manifest.json")
        state = json.loads(text) if text else None
        if state and state["run"] != self.run:
            raise ValueError(f"{self.path} holds another run: {state['run']}")
        return state

    def vectors(self, state: dict) -> dict[str, DataFrame]:
        return {k: self.spark.read.parquet(f"{self.path}/epoch-{state['epoch']}/{k}") for k in state["vectors"]}

    def put(self, epoch: int, vectors: dict[str, DataFrame], history: list[dict]) -> None:
        for k, v in vectors.items():
            v.write.mode("overwrite").parquet(f"{self.path}/epoch-{epoch}/{k}")
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"run": self.run, "epoch": epoch, "vectors": list(vectors), "history": history}))
        delete_path(self.spark, f"{self.path}/epoch-{epoch - 1}")


def train(edges: DataFrame, cfg: TrainConfig, variant: str = "undir", test: DataFrame | None = None, resume: str | None = None, until: int | None = None) -> tuple[Model, list[dict]]:
    """A model trained on edges, and a row of history for each epoch.

    test: src, dst, label; every eval_step epochs and at the end its ranking metrics join the history. Links are laid out once
    (see layout), so that no step shuffles them. Each step's coordinates are written to the shared folder, and those before are dropped. Within an epoch, batches of edge_cap links move one after the other.
    resume: a folder in which epochs are kept; a run whose driver was lost goes on after the last one there and ends with the same
    coordinates, as all that is drawn depends on epoch and node alone. until: the epoch to stop before, for a run in several parts.
    """
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "train")
    progress = resume and Progress(spark, resume, {"variant": variant, "config": json.loads(json.dumps(dataclasses.asdict(cfg)))})
    e = scratch.save(g.undirected(edges) if variant == "undir" else g.directed(edges), "edges")
    model = start(e, cfg, variant)
    links = {k: scratch.save(v, f"links-{k}") for k, v in links_of(e, variant).items()}
    ids = scratch.save(g.node_map(e), "ids")
    n = ids.count()
    model = replace(model, deg=scratch.save(model.deg, "deg"), vectors={k: scratch.bucketed(v, f"{k}-start", ["node"]) for k, v in model.vectors.items()})
    laid = lay(links, ids, model.deg, variant, HUB, scratch)
    cap = cfg.edge_cap and max(cfg.edge_cap, -(-sum(v.count() for v in links.values()) // cfg.max_batches))
    history, before, first = [], {k: f"{k}-start" for k in model.vectors}, 0
    state = progress.found() if progress else None
    if state:
        vectors = {k: scratch.bucketed(v, f"{k}-resumed", ["node"]) for k, v in progress.vectors(state).items()}
        model, history, first = replace(model, vectors=vectors), state["history"], state["epoch"] + 1
    for epoch in range(first, cfg.epochs if until is None else min(until, cfg.epochs)):
        batches, now = 1, laid
        if cap:
            with temporary():
                plan = scratch.save(batch_pack(links, cfg, epoch, cap), f"batches-{epoch}")
            batches = (plan.agg(F.max("batch")).first()[0] or 0) + 1
        if batches > 1:
            now = in_batches(laid, plan, epoch, scratch)
        sums = np.zeros(4)
        for b in range(batches):
            vectors = {}
            with temporary():
                moved = step(model, now, ids, n, epoch, b if batches > 1 else None)
                for k, m in moved.items():
                    label, seen = f"{k}-{epoch}-{b}", Observation()
                    of_write = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("loss", "pos", "neg")]]
                    m = scratch.save(m.observe(seen, *of_write), f"moved-{label}")
                    sums += np.array([float(seen.get[c]) for c in ("n", "loss", "pos", "neg")])
                    put = model.vectors[k].join(m.select("node", F.col("z").alias("new")), "node", "left").select("node", F.coalesce("new", "z").alias("z"))
                    vectors[k] = scratch.bucketed(put, label, ["node"])
            model = replace(model, vectors=vectors)
            scratch.drop(*before.values(), *[f"moved-{k}-{epoch}-{b}" for k in moved])
            before = {k: f"{k}-{epoch}-{b}" for k in moved}
        if now is not laid:
            now.drop(scratch)
        row = {"epoch": epoch, **dict(zip(("loss", "pos", "neg"), (sums[1:] / max(1.0, sums[0])).tolist(), strict=True))}
        if test is not None and ((epoch + 1) % cfg.eval_step == 0 or epoch + 1 == cfg.epochs):
            row |= evaluate(model, test)
        log.info("%s", row)
        history.append(row)
        if progress:
            progress.put(epoch, model.vectors, history)
    return model, history


def evaluate(model: Model, test: DataFrame) -> dict[str, float]:
    """Ranking metrics of test (src, dst, label)."""
    with temporary():
        return ranking_metrics(model.score(test)).first().asDict()


def sweep(runs: list[tuple[dict, DataFrame, DataFrame, TrainConfig, str]], at_once: int = 1) -> list[dict]:
    """Train and evaluate each run (names, train edges, test pairs, config, variant); a row of names and metrics for each, in their order.

    at_once: runs whose jobs share the cluster, each in a pool of its own; where the session's scheduler is FAIR they take turns by task.
    """

    def run(i: int, names: dict, edges: DataFrame, test: DataFrame, cfg: TrainConfig, variant: str) -> dict:
        sc = edges.sparkSession.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", f"sweep-{i % at_once}")
        try:
            return names | evaluate(train(edges, cfg, variant)[0], test)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(lambda x: run(x[0], *x[1]), enumerate(runs)))


def sweep_grid(edges: DataFrame, ratios: list[float], seeds: list[int], cfg: TrainConfig, variant: str = "undir", neg_ratio: float = 1, at_once: int = 2) -> DataFrame:
    """ratio, seed and ranking metrics of a run for each ratio of a random split and each seed; a row a run."""
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "sweep")
    e = scratch.save(g.undirected(edges) if variant == "undir" else g.directed(edges), "edges")
    runs = []
    for ratio in ratios:
        for seed in seeds:
            s = scratch.save(g.random_split(e, ratio, seed), f"split-{ratio}-{seed}")
            own = s.filter("part = 'train'").select("src", "dst")
            pos = scratch.save(g.transductive(s.filter("part = 'test'"), own), f"test-{ratio}-{seed}")
            neg = g.negatives_for(own, pos, neg_ratio, seed, strict=variant == "undir")
            test = scratch.save(pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0))), f"pairs-{ratio}-{seed}")
            runs.append(({"ratio": ratio, "seed": seed}, own, test, replace(cfg, seed=seed), variant))
    rows = sweep(runs, at_once)
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'bigint' if k == 'seed' else 'double'}" for k in rows[0]))
