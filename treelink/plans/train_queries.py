"""Queries of training steps and their parts on GE, and their SQL in long form."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SELECTORS, link_probability, pair_distance, selected
from ..operators import graph as g
from ..operators import metrics as m
from ..operators import training as t
from ..operators.order import tasks_for
from ..scratch import Scratch
from .fixtures import BITS, GE, ND, draw_sql, ge

#: Small, so that SQL can hold every candidate of every link; candidates from counters, so that SQL can draw them.
CFG = t.TrainConfig(height=5, dims=2, c=0.6, alpha=18.0, weight=1.5, epochs=2, portable=True)
EPOCH, RATIO = 1, 5
#: The general height and dimensions.
FULL = replace(CFG, height=12, dims=16, c=1.0)


def setting(spark: SparkSession, d: str, variant: str, cfg: t.TrainConfig = CFG) -> tuple[t.Model, dict[str, DataFrame], DataFrame, int]:
    """An untrained model on GE, its links, ids and number of nodes."""
    scratch = Scratch(spark, f"setting-{variant}")
    e = ge(spark, d)
    e = scratch.save(g.undirected(e) if variant == "undir" else g.directed(e), "edges")
    ids = scratch.save(g.node_map(e), "ids")
    return t.start(e, cfg, variant), t.links_of(e, variant), ids, ids.count()


def train_step(spark: SparkSession, d: str, variant: str, cfg: t.TrainConfig = CFG) -> DataFrame:
    model, links, ids, n = setting(spark, d, variant, cfg)
    out = None
    for name, moved in t.step(model, links, ids, n, EPOCH).items():
        rows = moved.select(F.lit(name).alias("vector"), "node", F.posexplode("z").alias("t", "z"), F.round("loss", 6).alias("loss"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("t", F.col("t").cast("bigint"))


def loss_terms(spark: SparkSession, d: str) -> DataFrame:
    model, links, ids, n = setting(spark, d, "undir")
    scratch = Scratch(spark, "losses")
    links = {k: scratch.save(v, k) for k, v in links.items()}
    z, deg = scratch.save(model.vectors["z"], "z"), scratch.save(model.deg, "deg")
    tasks = tasks_for(spark, 2 * sum(v.count() for v in links.values()))  # a negative for each link
    rows = t.branches(links, ids, n, CFG, EPOCH, "undir", tasks)["z"]
    return t.losses(t.with_ends(rows, z, z, deg, tasks), CFG)


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Edges of GE with the probabilities of the pair under undirected, out- and in-, and total degrees, and of the opposite edge."""
    e = Scratch(spark, "probabilities").save(g.directed(ge(spark, d)), "edges")
    loc = t.init_coordinates(g.nodes(e), CFG)
    per = g.degree(g.undirected(e)).withColumnRenamed("degree", "du").join(g.degree_out_in(e), "node").join(g.degree_total(e).withColumnRenamed("degree", "dt"), "node").join(loc, "node")
    side = lambda end, c: per.select(F.col("node").alias(end), *[F.col(x).alias(f"{c}_{x}") for x in ("z", "du", "out_degree", "in_degree", "dt")])
    j = e.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    dist = pair_distance(F.col("a_z"), F.col("b_z"), CFG.dims)
    p = lambda x, y: link_probability(dist, F.col(x), F.col(y), CFG.alpha, CFG.gamma, CFG.eps)
    return j.select("src", "dst", dist.alias("d"), p("a_du", "b_du").alias("p_undir"), p("a_out_degree", "b_in_degree").alias("p12"), p("b_out_degree", "a_in_degree").alias("p21"), p("a_dt", "b_dt").alias("p_total"))


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(c, 9).alias(c) for c in df.columns if c not in keys])


def selectors(spark: SparkSession, d: str) -> DataFrame:
    p: list[Column] = [F.col("p12"), F.col("p21")]
    return _rounded(probabilities(spark, d).select("src", "dst", *[selected(k, *p).alias(f"k_{k}") for k in SELECTORS]), ["src", "dst"])


def sample(spark: SparkSession, d: str) -> DataFrame:
    return t.neighbour_sample(t.links_of(g.directed(ge(spark, d)), "sr")["all"], CFG, EPOCH)


def flips(spark: SparkSession, d: str) -> DataFrame:
    out = t.candidates(t.init_coordinates(g.nodes(ge(spark, d)), CFG), CFG, EPOCH)
    return out.select("node", F.col("t").cast("bigint").alias("t"), F.col("l").cast("bigint").alias("l"), "cand")


def batches(spark: SparkSession, d: str) -> DataFrame:
    e = Scratch(spark, "batches").save(g.directed(ge(spark, d)), "edges")
    return t.batch_assign(g.nodes(e), g.adjacency(e), CFG, EPOCH, 512)


def node_mrr(spark: SparkSession, d: str) -> DataFrame:
    e = Scratch(spark, "node-mrr").save(g.directed(ge(spark, d)), "edges")
    ids = g.node_map(e)
    model = t.start(e, CFG, "sr")
    return m.node_mrr(e, lambda pairs: model.score(pairs).withColumn("score", F.round("score", 9)), ids, ids.count(), RATIO)


def node_mrr_many(spark: SparkSession, d: str) -> DataFrame:
    """A thousand negatives an edge."""
    e = Scratch(spark, "node-mrr").save(g.directed(ge(spark, d)), "edges")
    ids = Scratch(spark, "node-mrr").save(g.node_map(e), "ids")
    return m.node_mrr_blocks(e, t.start(e, CFG, "sr"), ids, ids.count(), 1000)


def swept(spark: SparkSession, d: str) -> DataFrame:
    """Mean and standard deviation over two seeds for each of two splits of GE."""
    rows = t.sweep_grid(ge(spark, d), [0.5, 0.8], [1, 2], replace(CFG, epochs=1))
    return rows.groupBy("ratio").agg(*[f(c).alias(f"{c}_{n}") for c in ("roc_auc", "average_precision", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def trained(spark: SparkSession, d: str) -> DataFrame:
    """Two portable epochs of the undirected loop: what SQL repeats step by step."""
    model, _ = t.train(ge(spark, d), replace(CFG, convergence=0.5), "undir")
    return model.vectors["z"].select("node", F.posexplode("z").alias("t", "z")).withColumn("t", F.col("t").cast("bigint"))


QUERIES = {
    **{f"train_step_{v}": (lambda s, d, v=v: train_step(s, d, v)) for v in ("undir", "sr", "dr")},
    "train_step_full": lambda s, d: train_step(s, d, "undir", FULL),
    "train_loop_portable": trained,
    "loss_pos": lambda s, d: loss_terms(s, d).select("node", F.round("pos", 9).alias("loss")),
    "loss_neg": lambda s, d: loss_terms(s, d).select("node", F.round("neg", 9).alias("loss")),
    "pair_distance": lambda s, d: probabilities(s, d).select("src", "dst", "d"),
    "link_prob": lambda s, d: _rounded(probabilities(s, d).drop("d"), ["src", "dst"]),
    "prob_selector": selectors,
    "choice_mask": lambda s, d: t.choice_mask(g.nodes(ge(s, d)), CFG, EPOCH),
    "neighbour_sample": sample,
    "flip_candidates": flips,
    "batch_assign": batches,
    "node_mrr": node_mrr,
    "node_mrr_1000": node_mrr_many,
    "sweep_summary": swept,
}

_H, _K = CFG.height, CFG.per_level
_IX = "ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nd), nn AS (SELECT count(*) AS n FROM ix)"
_U = "u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e)"
_OI = "oi AS (SELECT node, sum(o)::bigint AS d1, sum(i)::bigint AS d2 FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1)"
_DU = "du AS (SELECT node, count(*) AS d1, count(*) AS d2 FROM (SELECT src AS node FROM u UNION ALL SELECT dst FROM u) GROUP BY 1)"
LINKS = {
    "all": "(SELECT src AS node, dst AS nbr FROM e UNION SELECT dst, src FROM e)",
    "out": "(SELECT src AS node, dst AS nbr FROM e)",
    "in": "(SELECT dst AS node, src AS nbr FROM e)",
}
_SELECT = {"out": "p12", "in": "p21", "not_out": "1 - p12", "not_in": "1 - p21", "neither": "(1 - p12) * (1 - p21)"}
_CASE = "CASE key " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SELECT.items()) + " END"


def keep_sql(epoch: int, share: float) -> str:
    return f"{draw_sql('1', chr(39) + 'mask' + chr(39), str(epoch), 'node')} % 1000 < 800" if epoch <= share * CFG.epochs else "true"


def _loc(name: str = "z", cfg: t.TrainConfig = CFG) -> str:
    return f"(SELECT node, t, {draw_sql('1', chr(39) + name + chr(39), 'node', 't')} % {1 << cfg.height} AS z FROM nd, (SELECT unnest(range({cfg.dims})) AS t))"


def _used(kind: str, epoch: int, share: float, p: str = "") -> str:
    return f"""{p}only_{kind} AS (SELECT node, arg_min(nbr, {draw_sql('1', "'one'", f"'{kind}'", str(epoch), 'node', 'nbr')}) AS one FROM {LINKS[kind]} GROUP BY 1),
{p}used_{kind} AS MATERIALIZED (SELECT l.node, l.nbr FROM {LINKS[kind]} l JOIN {p}only_{kind} o ON o.node = l.node WHERE {keep_sql(epoch, share).replace(', node', ', l.node')} OR l.nbr = o.one),
{p}cnt_{kind} AS (SELECT node, count(*) AS cnt FROM {p}used_{kind} GROUP BY 1),
{p}neg_{kind} AS (SELECT x.node, ix.node AS nbr FROM {p}used_{kind} x JOIN ix ON ix.idx = {draw_sql('1', "'neg'", f"'{kind}'", str(epoch), 'x.node', 'x.nbr')} % (SELECT n FROM nn))"""


def _move(p: str, name: str, rows: list[tuple[str, str, int]], cnt: str, own: str, other: str, deg: str, epoch: int, cfg: t.TrainConfig = CFG) -> str:
    """CTEs up to {p}best: vector, node, t, z, total, pos and neg of each place that a vector moves to."""
    union = " UNION ALL ".join(f"SELECT node, nbr, '{key}' AS key, {y} AS y FROM {of}" for of, key, y in rows)
    b = lambda x, y: BITS.format(a=x, b=y)
    prob = lambda dd, n: f"CASE WHEN {n} > 0 THEN 1.0::double / (1.0::double + pow(({dd} + 1e-5::double) / {n}, 3.0::double) / 18.0::double) ELSE 0.0::double END"
    return f"""{p}rows AS MATERIALIZED (SELECT row_number() OVER () AS id, r.*, cnt, ln(((a.d1 + 1) * (b.d2 + 1))::double) AS n12, ln(((b.d1 + 1) * (a.d2 + 1))::double) AS n21
    FROM ({union}) r JOIN {cnt} USING (node) JOIN {deg} a ON a.node = r.node JOIN {deg} b ON b.node = r.nbr),
{p}cur AS MATERIALIZED (SELECT id, x.t, y.z AS z2, {b('x.z', 'y.z')} AS now FROM {p}rows r JOIN {own} x ON x.node = r.node JOIN {other} y ON y.node = r.nbr AND y.t = x.t),
{p}tot AS (SELECT id, sum(now) AS total FROM {p}cur GROUP BY 1),
{p}cand AS MATERIALIZED (SELECT node, t, l, CASE WHEN l = {cfg.height * cfg.per_level} THEN z ELSE xor(xor(z, 1::bigint << (l // {cfg.per_level})::int), {draw_sql('1', "'m'", f"'{name}'", str(epoch), 'node', 'l', 't')} % (1::bigint << (l // {cfg.per_level})::int)) END AS cand FROM {own}, (SELECT unnest(range({cfg.candidates})) AS l)),
{p}lo AS (SELECT node, t, l, cand, y, key, cnt, {prob('dd', 'n12')} AS p12, {prob('dd', 'n21')} AS p21
    FROM (SELECT r.node, c.t, c.l, c.cand, r.y, r.key, r.cnt, n12, n21, ({b('c.cand', 'q.z2')} - q.now + total)::double / {cfg.dims} AS dd FROM {p}rows r JOIN {p}tot USING (id) JOIN {p}cur q USING (id) JOIN {p}cand c ON c.node = r.node AND c.t = q.t)),
{p}ls AS (SELECT node, t, l, any_value(cand) AS cand, sum(CASE WHEN y = 1 THEN -ln(1e-5::double + {_CASE}) ELSE 0 END / cnt) AS pos, sum(CASE WHEN y = 0 THEN -ln(1e-5::double + {_CASE}) ELSE 0 END / cnt) AS neg FROM {p}lo GROUP BY 1, 2, 3),
{p}best AS MATERIALIZED (SELECT '{name}' AS vector, node, t, cand AS z, 1.5 * pos + neg AS total, pos, neg FROM {p}ls QUALIFY row_number() OVER (PARTITION BY node, t ORDER BY round(1.5 * pos + neg, 9), {draw_sql('1', "'tie'", str(epoch), 'node', 'l')}) = 1)"""


def _result(*best: str) -> str:
    return " UNION ALL ".join(f"SELECT vector, node, t, z, round(avg(total) OVER (PARTITION BY node), 6) AS loss FROM {b}" for b in best)


_UNDIR = f"WITH {GE}, {ND}, {_IX}, {_U}, {_DU}, z0 AS MATERIALIZED {_loc()}, "
_ROWS = [("used_all", "out", 1), ("neg_all", "not_out", 0)]
_P = lambda d, x, y: f"CASE WHEN ({x} + 1) * ({y} + 1) = 1 THEN 0.0::double ELSE 1.0::double / (1.0::double + pow(({d} + 1e-5::double) / ln((({x} + 1) * ({y} + 1))::double), 3.0::double) / 18.0::double) END"
_PROBS = f"""WITH {GE}, {ND}, {_U}, {_DU}, {_OI}, z0 AS {_loc()},
dd AS (SELECT e.src, e.dst, avg({BITS.format(a='a.z', b='b.z')})::double AS d FROM e JOIN z0 a ON a.node = src JOIN z0 b ON b.node = dst AND b.t = a.t GROUP BY 1, 2),
pr AS (SELECT src, dst, d, {_P('d', 'x.d1', 'y.d1')} AS p_undir, {_P('d', 'a.d1', 'b.d2')} AS p12, {_P('d', 'b.d1', 'a.d2')} AS p21, {_P('d', '(a.d1 + a.d2)', '(b.d1 + b.d2)')} AS p_total
    FROM dd JOIN du x ON x.node = src JOIN du y ON y.node = dst JOIN oi a ON a.node = src JOIN oi b ON b.node = dst)"""

SQL = {
    "train_step_undir": _UNDIR + _used("all", EPOCH, 0.8) + ", " + _move("", "z", _ROWS, "cnt_all", "z0", "z0", "du", EPOCH) + " " + _result("best"),
    "train_step_full": f"WITH {GE}, {ND}, {_IX}, {_U}, {_DU}, z0 AS MATERIALIZED {_loc(cfg=FULL)}, " + _used("all", EPOCH, 0.8) + ", " + _move("", "z", _ROWS, "cnt_all", "z0", "z0", "du", EPOCH, FULL) + " " + _result("best"),
    "train_step_sr": f"WITH {GE}, {ND}, {_IX}, {_OI}, z0 AS MATERIALIZED {_loc()}, " + ", ".join(_used(k, EPOCH, 0.8) for k in ("all", "out", "in")) + ", " + _move("", "z", [("used_out", "out", 1), ("used_in", "in", 1), ("neg_all", "neither", 0)], "cnt_all", "z0", "z0", "oi", EPOCH) + " " + _result("best"),
    "train_step_dr": f"WITH {GE}, {ND}, {_IX}, {_OI}, h0 AS MATERIALIZED {_loc('head')}, t0 AS MATERIALIZED {_loc('tail')}, " + ", ".join(_used(k, EPOCH, 0.8) for k in ("out", "in"))
    + ", " + _move("h_", "head", [("used_out", "out", 1), ("neg_out", "not_out", 0)], "cnt_out", "h0", "t0", "oi", EPOCH)
    + ", " + _move("t_", "tail", [("used_in", "in", 1), ("neg_in", "not_in", 0)], "cnt_in", "t0", "h0", "oi", EPOCH) + " " + _result("h_best", "t_best"),
    "train_loop_portable": _UNDIR + _used("all", 0, 0.5, "a_") + ", " + _move("a_", "z", [("a_used_all", "out", 1), ("a_neg_all", "not_out", 0)], "a_cnt_all", "z0", "z0", "du", 0)
    + ", " + _used("all", 1, 0.5, "b_") + ", " + _move("b_", "z", [("b_used_all", "out", 1), ("b_neg_all", "not_out", 0)], "b_cnt_all", "a_best", "a_best", "du", 1) + " SELECT node, t, z FROM b_best",
    **{f"loss_{x}": _UNDIR + _used("all", EPOCH, 0.8) + ", " + _move("", "z", _ROWS, "cnt_all", "z0", "z0", "du", EPOCH) + f" SELECT node, round({x}, 9) AS loss FROM ls WHERE l = {_H * _K} AND t = 0" for x in ("pos", "neg")},
    "pair_distance": f"{_PROBS} SELECT src, dst, d FROM pr",
    "link_prob": f"{_PROBS} SELECT src, dst, round(p_undir, 9) AS p_undir, round(p12, 9) AS p12, round(p21, 9) AS p21, round(p_total, 9) AS p_total FROM pr",
    "prob_selector": f"{_PROBS} SELECT src, dst, " + ", ".join(f"round({v}, 9) AS k_{k}" for k, v in _SELECT.items()) + " FROM pr",
    "choice_mask": f"WITH {GE}, {ND} SELECT node, {keep_sql(EPOCH, 0.8)} AS keep FROM nd",
    "neighbour_sample": f"WITH {GE}, {ND}, {_IX}, {_used('all', EPOCH, 0.8)} SELECT node, nbr FROM used_all",
    "flip_candidates": f"WITH {GE}, {ND} SELECT node, t, l, CASE WHEN l = {_H * _K} THEN z ELSE xor(xor(z, 1::bigint << (l // {_K})::int), {draw_sql('1', chr(39) + 'm' + chr(39), chr(39) + 'z' + chr(39), str(EPOCH), 'node', 'l', 't')} % (1::bigint << (l // {_K})::int)) END AS cand FROM {_loc()}, (SELECT unnest(range({_H * _K + 1})) AS l)",
    "batch_assign": f"WITH {GE}, {ND}, c AS (SELECT node, CASE WHEN {keep_sql(EPOCH, 0.8)} THEN count(*) ELSE 1 END AS cost FROM {LINKS['all']} GROUP BY node) SELECT node, cost, floor((sum(cost) OVER (ORDER BY {draw_sql('1', chr(39) + 'batch' + chr(39), str(EPOCH), 'node')}, node) - cost) / 512)::bigint AS batch FROM c",
    **{name: f"""WITH {GE}, {ND}, {_IX}, {_OI}, z0 AS MATERIALIZED {_loc()},
drawn AS (SELECT src, dst, i, {draw_sql('1', "'nm'", 'src', 'dst', 'i')} % (SELECT n FROM nn) AS idx FROM e, (SELECT unnest(range({ratio})) AS i)),
pairs AS (SELECT row_number() OVER () AS id, * FROM (SELECT src, dst, dst AS v, 1 AS own FROM e UNION ALL SELECT src, dst, node, 0 FROM drawn JOIN ix USING (idx))),
dist AS (SELECT id, avg({BITS.format(a='a.z', b='b.z')})::double AS d FROM pairs JOIN z0 a ON a.node = src JOIN z0 b ON b.node = v AND b.t = a.t GROUP BY 1),
sc AS (SELECT src, dst, own, round({_P('d', 'a.d1', 'b.d2')}, 9) AS s FROM pairs JOIN dist USING (id) JOIN oi a ON a.node = src JOIN oi b ON b.node = v),
rk AS (SELECT src, dst, sum(CASE WHEN own = 0 AND s > o THEN 1 ELSE 0 END) AS above, sum(CASE WHEN own = 0 AND s >= o THEN 1 ELSE 0 END) AS upto FROM (SELECT *, max(CASE WHEN own = 1 THEN s END) OVER (PARTITION BY src, dst) AS o FROM sc) GROUP BY 1, 2)
SELECT round(avg(1.0::double / (above + 1)), 9) AS mrr_opt, round(avg(1.0::double / (upto + 1)), 9) AS mrr_pess FROM rk""" for name, ratio in (("node_mrr", RATIO), ("node_mrr_1000", 1000))},
}
