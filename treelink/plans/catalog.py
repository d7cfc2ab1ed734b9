"""Queries over fixture graphs, and their SQL; those of splits and of training are in modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tree_distance
from ..operators import graph as g
from ..operators import metrics as m
from ..operators import training as t
from ..scratch import Scratch
from ..sources.edges import exact_graph, random_graph
from . import dense_queries, split_queries, train_queries
from .fixtures import BITS as _BITS
from .fixtures import GC as _GC
from .fixtures import GE as _GE
from .fixtures import GP as _GP
from .fixtures import ND as _ND
from .fixtures import draw_sql as _draw
from .fixtures import gc, ge, gp
from .fixtures import split_sql as _split_sql
from .fixtures import table as _t

FLAGSHIP = "ranking_metrics_sampled"
CFG = t.TrainConfig(alpha=18.0)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Untrained scores of the edges of GE and of as many shifted pairs, whose targets are 15 nodes only and may be edges: no measure of ranking, see sampled()."""
    scratch = Scratch(spark, "scored")
    e = scratch.save(g.directed(ge(spark, d)), "edges")
    loc = t.init_coordinates(g.nodes(e), CFG)
    deg = t.degrees_for(e, True)
    pairs = e.withColumn("label", F.lit(1)).unionByName(e.select("src", F.expr("(dst * 7 + src * 3 + 1) % 15").cast("bigint").alias("dst"), F.lit(0).alias("label")))
    return t.score_pairs(pairs, loc, deg, CFG).withColumn("score", F.round("score", 9))


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """Untrained scores of the edges of GE and of as many pairs drawn over all its nodes that are no edges, or all free pairs the draws find if there are fewer."""
    scratch = Scratch(spark, "sampled")
    e = scratch.save(g.directed(ge(spark, d)), "edges")
    loc = t.init_coordinates(g.nodes(e), CFG)
    deg = t.degrees_for(e, True)
    drawn = g.negatives(e, e.count(), seed=2, strict=False)
    pairs = e.withColumn("label", F.lit(1)).unionByName(drawn.withColumn("label", F.lit(0)))
    return t.score_pairs(pairs, loc, deg, CFG).withColumn("score", F.round("score", 9))


def train_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates after training on GE with the general defaults."""
    model, _ = t.train(ge(spark, d), t.TrainConfig(), "undir")
    return model.vectors["z"]


def split(spark: SparkSession, d: str) -> DataFrame:
    return g.random_split(g.directed(ge(spark, d)), 0.5, seed=1)


def transductive(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "transductive").save(g.random_split(g.directed(gc(spark, d)), 0.5, seed=1), "split")
    return g.transductive(s.filter("part = 'test'"), s.filter("part = 'train'").select("src", "dst"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    runs = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("dataset"), (F.col("l_discount") * 1.0).cast("double").alias("roc_auc"))
    return m.run_statistics(runs, ["dataset"], "roc_auc")


def summary_text(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as 1 in 128ths, which both engines add without rounding."""
    part = lambda c: (F.col(c).cast("bigint") % 128) / F.lit(128.0)
    runs = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("dataset"), part("l_partkey").alias("roc_auc"), F.when(F.col("l_linenumber") < 5, part("l_orderkey")).alias("f1"))
    return m.run_summary(runs, ["dataset"], ["roc_auc", "f1"])


def distances(spark: SparkSession, d: str) -> DataFrame:
    e = g.directed(ge(spark, d))
    return e.select("src", "dst", tree_distance(F.col("src"), F.col("dst")).cast("bigint").alias("delta"))


def size_of(spark: SparkSession, d: str) -> tuple[int, int]:
    """Numbers of nodes and edges of GC, for random graphs of its size."""
    e = Scratch(spark, "size").save(g.directed(gc(spark, d)), "edges")
    return g.nodes(e).count(), e.count()


def like_gc(spark: SparkSession, d: str, is_directed: bool) -> DataFrame:
    """As many random edges as GC has, the first that counters draw over as many nodes."""
    n, edges = size_of(spark, d)
    return exact_graph(spark, n, edges, 42, is_directed)


QUERIES = {
    "edges_directed_dedup": lambda s, d: g.directed(ge(s, d)),
    "edges_undirected_dedup": lambda s, d: g.undirected(ge(s, d)),
    "node_map": lambda s, d: g.node_map(ge(s, d)),
    "degree_undirected": lambda s, d: g.degree(g.undirected(ge(s, d))),
    "degree_out_in": lambda s, d: g.degree_out_in(g.directed(ge(s, d))),
    "degree_distinct_nbrs": lambda s, d: g.degree_distinct(g.directed(ge(s, d))),
    "adjacency": lambda s, d: g.adjacency(ge(s, d)),
    "temporal_pair_min": lambda s, d: g.temporal_pairs(gp(s, d), "min"),
    "temporal_pair_median": lambda s, d: g.temporal_pairs(gp(s, d), "median"),
    "temporal_pair_max": lambda s, d: g.temporal_pairs(gp(s, d), "max"),
    "temporal_thresholds": lambda s, d: g.temporal_thresholds(g.temporal_pairs(gp(s, d), "min"), [0.1, 0.5, 0.9]),
    "temporal_split": lambda s, d: g.temporal_split(g.temporal_pairs(gp(s, d), "min"), 900.0),
    "split_random": split,
    "transductive_filter": transductive,
    "test_degree": lambda s, d: g.test_degree(g.nodes(ge(s, d)), g.directed(ge(s, d))),
    "tree_distance": distances,
    "coord_init": lambda s, d: t.init_coordinates(g.nodes(ge(s, d)), CFG).select("node", F.explode("z").alias("z")).groupBy("node").agg(F.sum("z").alias("z_sum")),
    "score_pairs": lambda s, d: scored(s, d).select("src", "dst", F.col("label").cast("bigint").alias("label"), "score"),
    "ranking_metrics": lambda s, d: m.ranking_metrics(scored(s, d)),
    "score_pairs_sampled": lambda s, d: sampled(s, d).select("src", "dst", F.col("label").cast("bigint").alias("label"), "score"),
    "ranking_metrics_sampled": lambda s, d: m.ranking_metrics(sampled(s, d)),
    "run_statistics": summary,
    "er_directed": lambda s, d: random_graph(s, *size_of(s, d), 42, True),
    "er_undirected": lambda s, d: random_graph(s, *size_of(s, d), 42, False),
    "er_gnp_directed": lambda s, d: like_gc(s, d, True),
    "er_gnp_undirected": lambda s, d: like_gc(s, d, False),
    "negatives_strict": lambda s, d: g.negatives(g.directed(gc(s, d)), 2000, seed=3),
    "train_epochs": train_epochs,
    "run_summary": summary_text,
} | split_queries.QUERIES | train_queries.QUERIES | dense_queries.QUERIES

_SCORED = f"""
loc AS (SELECT node, i, {_draw("1", "'z'", "node", "i")} % 4096 AS z FROM nd, (SELECT unnest(range(16)) AS i)),
o AS (SELECT src AS node, count(*) AS d FROM e GROUP BY 1), n AS (SELECT dst AS node, count(*) AS d FROM e GROUP BY 1),
pairs AS (SELECT src, dst, 1 AS label FROM e UNION ALL SELECT src, ((dst * 7 + src * 3 + 1) % 15)::bigint, 0 FROM e),
numbered AS (SELECT row_number() OVER () AS id, * FROM pairs),
dist AS (SELECT p.id, sum({_BITS.format(a="a.z", b="b.z")})::double / 16 AS dd FROM numbered p JOIN loc a ON a.node = p.src JOIN loc b ON b.node = p.dst AND b.i = a.i GROUP BY 1),
sc AS (SELECT p.src, p.dst, p.label::bigint AS label, round(CASE WHEN (coalesce(o.d, 0) + 1) * (coalesce(n.d, 0) + 1) = 1 THEN 0.0::double ELSE 1.0::double / (1.0::double + pow((dd + 1e-5::double) / ln(((coalesce(o.d, 0) + 1) * (coalesce(n.d, 0) + 1))::double), 3.0::double) / 18.0::double) END, 9) AS score
       FROM numbered p JOIN dist USING (id) LEFT JOIN o ON o.node = p.src LEFT JOIN n ON n.node = p.dst)"""

#: negatives() of as many pairs as edges: the first of its draws that are free; beyond 64 times its first number of draws it ends.
_SAMPLED = f"""ix AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nd),
draws AS (SELECT id, {_draw("2", "'x'", "id")} % (SELECT count(*) FROM nd) AS i, {_draw("2", "'y'", "id")} % (SELECT count(*) FROM nd) AS j FROM (SELECT unnest(range((SELECT 64 * (2 * count(*) + 16) FROM e))) AS id)),
free AS (SELECT a.node AS src, b.node AS dst, min(id) AS id FROM draws JOIN ix a ON a.idx = i JOIN ix b ON b.idx = j WHERE i <> j GROUP BY 1, 2),
neg AS (SELECT src, dst FROM free ANTI JOIN e USING (src, dst) ORDER BY id LIMIT (SELECT count(*) FROM e)),
""" + _SCORED.replace("SELECT src, ((dst * 7 + src * 3 + 1) % 15)::bigint, 0 FROM e", "SELECT src, dst, 0 FROM neg")

_METRICS = """, k AS (SELECT score, sum(label)::double AS p, sum(1 - label)::double AS n FROM sc GROUP BY 1),
r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM k), tt AS (SELECT sum(p) AS pp, sum(n) AS nn FROM k)
SELECT round(sum(n * (cp - p / 2) / (pp * nn)), 9) AS roc_auc, round(sum(p / pp * cp / (cp + cn)), 9) AS average_precision, round(sum(p / (cn - n + 1) / pp), 9) AS mrr_opt, round(sum(p / (cn + 1) / pp), 9) AS mrr_pess,
       round(arg_min(2 * cp / (cp + cn + pp), cp + cn) FILTER (WHERE cp + cn >= pp), 9) AS f1,
       """ + ", ".join(f"round(sum(p * CASE WHEN nn < {k} OR cn < {k} THEN 1.0::double WHEN cn - n < {k} THEN 0.5::double ELSE 0.0::double END / pp), 9) AS hits{k}" for k in (20, 50, 100)) + " FROM r, tt"

_SIZE = "sz AS MATERIALIZED (SELECT (SELECT count(*) FROM (SELECT src FROM gc UNION SELECT dst FROM gc)) AS n, (SELECT count(*) FROM gc) AS m)"
_ER = f"c AS (SELECT id, {_draw('42', chr(39) + 'u' + chr(39), 'id')} % n AS a, {_draw('42', chr(39) + 'v' + chr(39), 'id')} % n AS b FROM (SELECT unnest(range((SELECT {{draws}} FROM sz))) AS id), sz)"


def _er(pair: str) -> str:
    return f"WITH {_GC}, {_SIZE}, {_ER.format(draws='m')} SELECT DISTINCT {pair} FROM c WHERE a <> b"


def _exact(pair: str) -> str:
    return f"WITH {_GC}, {_SIZE}, {_ER.format(draws='2 * m + 16')} SELECT {pair} FROM c WHERE a <> b GROUP BY ALL ORDER BY min(id) LIMIT (SELECT m FROM sz)"


SQL = {
    "er_gnp_directed": _exact("a AS src, b AS dst"),
    "er_gnp_undirected": _exact("least(a, b) AS src, greatest(a, b) AS dst"),
    "edges_directed_dedup": f"WITH {_GE} SELECT src, dst FROM e",
    "edges_undirected_dedup": f"WITH {_GE} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e",
    "node_map": f"WITH {_GE}, {_ND} SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nd",
    "degree_undirected": f"WITH {_GE}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY 1",
    "degree_out_in": f"WITH {_GE} SELECT node, sum(o)::bigint AS out_degree, sum(i)::bigint AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1",
    "degree_distinct_nbrs": f"WITH {_GE} SELECT a AS node, count(*) AS degree FROM (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) GROUP BY 1",
    "adjacency": f"WITH {_GE} SELECT src AS node, dst AS nbr FROM e UNION SELECT dst, src FROM e",
    **{f"temporal_pair_{how}": f"WITH {_GP} SELECT src, dst, {how}(t)::double AS t FROM gp GROUP BY 1, 2" for how in ("min", "median", "max")},
    "temporal_thresholds": f"WITH {_GP}, p AS (SELECT min(t)::double AS t FROM gp GROUP BY src, dst), o AS (SELECT t, row_number() OVER (ORDER BY t) AS k, count(*) OVER () AS n FROM p), r AS (SELECT unnest([0.1::double, 0.5::double, 0.9::double]) AS ratio) SELECT ratio, t AS threshold FROM o, r WHERE k = greatest(1, floor(n * ratio))",
    "temporal_split": f"WITH {_GP}, p AS (SELECT src, dst, min(t)::double AS t FROM gp GROUP BY 1, 2) SELECT src, dst, t, CASE WHEN t < 900 THEN 'train' ELSE 'test' END AS part FROM p",
    "split_random": f"WITH {_GE}, {_split_sql('e')} SELECT * FROM s",
    "transductive_filter": f"WITH {_GC}, {_split_sql('gc')}, k AS (SELECT src AS node FROM s WHERE part = 'train' UNION SELECT dst FROM s WHERE part = 'train') SELECT src, dst FROM s WHERE part = 'test' AND src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)",
    "test_degree": f"WITH {_GE}, {_ND} SELECT node, count(src)::bigint AS test_degree FROM nd LEFT JOIN e ON src = node GROUP BY 1",
    "tree_distance": f"WITH {_GE} SELECT src, dst, ({_BITS.format(a='src', b='dst')})::bigint AS delta FROM e",
    "coord_init": f"WITH {_GE}, {_ND} SELECT node, sum({_draw('1', chr(39) + 'z' + chr(39), 'node', 'i')} % 4096)::bigint AS z_sum FROM nd, (SELECT unnest(range(16)) AS i) GROUP BY 1",
    "score_pairs": f"WITH {_GE}, {_ND}, {_SCORED} SELECT src, dst, label, score FROM sc",
    "ranking_metrics": f"WITH {_GE}, {_ND}, {_SCORED} {_METRICS}",
    "score_pairs_sampled": f"WITH {_GE}, {_ND}, {_SAMPLED} SELECT src, dst, label, score FROM sc",
    "ranking_metrics_sampled": f"WITH {_GE}, {_ND}, {_SAMPLED} {_METRICS}",
    "run_statistics": "SELECT l_suppkey::bigint AS dataset, round(avg(l_discount::double), 9) AS mean, round(stddev_pop(l_discount::double), 9) AS std FROM lineitem GROUP BY 1",
    "er_directed": _er("a AS src, b AS dst"),
    "er_undirected": _er("least(a, b) AS src, greatest(a, b) AS dst"),
    "run_summary": "SELECT l_suppkey::bigint AS dataset, " + ", ".join(f"printf('%.2f±%.2f', avg({v}) * 100, stddev_pop({v}) * 100) AS {n}" for n, v in (("roc_auc", "(l_partkey % 128) / 128.0::double"), ("f1", "CASE WHEN l_linenumber < 5 THEN (l_orderkey % 128) / 128.0::double END"))) + " FROM lineitem GROUP BY 1",
} | split_queries.SQL | train_queries.SQL | dense_queries.SQL
