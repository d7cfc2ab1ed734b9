"""Queries of graphs that are nearly complete, of batches packed one after the other, of compressed adjacency and of splits by time, and their SQL.

GS, a graph of suppliers: those of consecutive lines of an order. At scale 0.01 it has about 99 of 100 possible edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import training as t
from ..scratch import Scratch
from .fixtures import GC, GE, GP, draw_sql, gc, ge, gp, split_sql, table
from .split_queries import contract_parts, negatives_sql, per_node_sql
from .train_queries import CFG, EPOCH, LINKS, keep_sql

#: Links in a batch, and neighbours in a block: small beside the graphs, so that both are cut often.
CAP, HUB = 512, 16


def gs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("bigint").alias("src"))
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    return Scratch(spark, "gs").save(g.directed(a.join(b, ["l_orderkey", "l_linenumber"])), "edges")


def free_of(e: DataFrame) -> int:
    """Number of ordered pairs of nodes of e that are no edges and no loops."""
    n = g.nodes(e).count()
    return n * n - n - e.filter("src <> dst").count()


def dense_all(spark: SparkSession, d: str) -> DataFrame:
    """More pairs than are free: all of them."""
    e = gs(spark, d)
    return g.negatives(e, free_of(e) + 1, seed=7, strict=False)


def dense_most(spark: SparkSession, d: str) -> DataFrame:
    """Nine tenths of the free pairs: more than draws find."""
    e = gs(spark, d)
    return g.negatives(e, free_of(e) * 9 // 10, seed=7, strict=False)


def dense_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs without direction that aren't linked in either, all of them."""
    e = gs(spark, d)
    return g.negatives(e, free_of(e) + 1, seed=7)


def batches(spark: SparkSession, d: str, variant: str) -> DataFrame:
    e = gc(spark, d) if variant == "undir" else ge(spark, d)
    e = Scratch(spark, "packed").save(g.undirected(e) if variant == "undir" else g.directed(e), "edges")
    return t.batch_pack(t.links_of(e, variant), CFG, EPOCH, CAP)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return Scratch(spark, "blocks").save(g.adjacency_blocks(gc(spark, d), HUB), "blocks")


def faults(spark: SparkSession, d: str) -> DataFrame:
    """The contract on GC as it is, with a block of negatives short, with positives out of order, and with a degree that is off."""
    pos, neg, deg = contract_parts(spark, d)
    last = neg.filter("row < 1")
    cases = {
        "none": (pos, neg, deg),
        "negatives": (pos, neg.join(last, ["src", "dst", "row"], "left_anti"), deg),
        "order": (pos.withColumn("row", -F.col("row")), neg, deg),
        "degrees": (pos, neg, deg.withColumn("test_degree", F.when(F.col("test_degree") > 0, F.col("test_degree") + 1).otherwise(F.lit(0)))),
    }
    out = None
    for name, parts in cases.items():
        one = g.contract(*parts, 20).select(F.lit(name).alias("fault"), "*")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "negatives_dense_all": dense_all,
    "negatives_dense_most": dense_most,
    "negatives_dense_pairs": dense_pairs,
    "negatives_per_node_dense": lambda s, d: (lambda e: g.negatives_per_node(e, g.nodes(e), 2, seed=9))(gs(s, d)),
    **{f"batch_pack_{v}": (lambda s, d, v=v: batches(s, d, v)) for v in ("undir", "sr", "dr")},
    "adjacency_blocks": lambda s, d: blocks(s, d).select("node", "offset", "n", "first", F.array_join(F.transform("deltas", lambda x: x.cast("string")), ",").alias("deltas")),
    "adjacency_pointers": lambda s, d: g.row_pointers(blocks(s, d)),
    "adjacency_from_blocks": lambda s, d: g.from_blocks(blocks(s, d)),
    "temporal_split_ratio": lambda s, d: g.temporal_split_at(g.temporal_pairs(gp(s, d), "median"), 0.8),
    "unseen_nodes_sparse": lambda s, d: (lambda p: g.unseen_nodes(p.filter("part = 'test'"), g.nodes(p.filter("part = 'train'"))))(Scratch(s, "sparse").save(g.random_split(g.directed(gc(s, d)), 0.02, seed=1), "split")),
    "split_contract_faults": faults,
}

GS = "gs AS MATERIALIZED (SELECT DISTINCT a.l_suppkey::bigint AS src, b.l_suppkey::bigint AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1), sn AS MATERIALIZED (SELECT src AS node FROM gs UNION SELECT dst FROM gs)"
_FREE = "SELECT a.node AS src, b.node AS dst FROM sn a, sn b WHERE a.node <> b.node AND (a.node, b.node) NOT IN (SELECT (src, dst) FROM gs)"
#: strata() of the j-th of `wanted` ranks below `free`.
_EDGE = "({j}) * ({f} // {w}) + (({j}) * ({f} % {w})) // {w}"


def _strata(j: str, free: str, wanted: str, draw: str) -> str:
    low, high = _EDGE.format(j=j, f=free, w=wanted), _EDGE.format(j=f"{j} + 1", f=free, w=wanted)
    return f"({low}) + {draw} % (({high}) - ({low}))"


_MOST = f"""WITH {GS}, {negatives_sql('SELECT node FROM sn', 'SELECT src, dst FROM gs', f'SELECT (SELECT count(*) FROM ({_FREE})) * 9 // 10 AS num', 7, False)},
found AS MATERIALIZED (SELECT * FROM neg), left_over AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS r FROM ({_FREE}) ANTI JOIN found USING (src, dst)),
w AS (SELECT (SELECT num FROM want) - (SELECT count(*) FROM found) AS wanted, (SELECT count(*) FROM left_over) AS free),
rk AS (SELECT {_strata('j', 'free', 'wanted', draw_sql('7', "'rank'", 'j'))} AS r FROM w, (SELECT unnest(range((SELECT wanted FROM w))) AS j))
SELECT src, dst FROM found UNION ALL SELECT src, dst FROM left_over JOIN rk USING (r)"""

_PER_DENSE = f"""WITH {GS}, ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM sn), nn AS (SELECT count(*) AS n FROM ix),
dr AS (SELECT node AS src, i, {draw_sql("9", "'pn'", "node", "i")} % n AS idx FROM ix, (SELECT unnest(range(8)) AS i), nn),
ok AS (SELECT src, node AS dst, min(i) AS i FROM dr JOIN ix USING (idx) WHERE src <> node GROUP BY 1, 2),
fr AS MATERIALIZED (SELECT src, dst FROM ok ANTI JOIN gs USING (src, dst) QUALIFY row_number() OVER (PARTITION BY src ORDER BY i) <= 2),
lo AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS r, count(*) OVER (PARTITION BY src) AS free FROM ({_FREE}) ANTI JOIN fr USING (src, dst)),
sh AS (SELECT src, any_value(free) AS free, least(2 - (SELECT count(*) FROM fr WHERE fr.src = lo.src), any_value(free)) AS wanted FROM lo GROUP BY src),
rk AS (SELECT src, {_strata('j', 'free', 'wanted', draw_sql('9', "'rank'", 'src', 'j'))} AS r FROM (SELECT src, free, wanted, unnest(range(wanted)) AS j FROM sh WHERE wanted > 0)),
al AS (SELECT src, dst FROM fr UNION ALL SELECT src, dst FROM lo JOIN rk USING (src, r)) SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS row FROM al"""


def _packed(graph: str, kinds: tuple[str, ...], loops: str) -> str:
    """Batches by a packer that goes from start to start."""
    rows = " UNION ALL ".join(f"SELECT node, '{k}' AS kind FROM {LINKS[k]}" for k in kinds)
    return f"""WITH RECURSIVE {graph}, {loops} kn AS (SELECT node, kind, count(*) AS n FROM ({rows}) GROUP BY 1, 2),
cs AS (SELECT node, sum(CASE WHEN {keep_sql(EPOCH, 0.8)} THEN n ELSE 1 END)::bigint AS cost FROM kn GROUP BY 1),
od AS MATERIALIZED (SELECT node, cost, row_number() OVER w AS pos, (sum(cost) OVER w)::bigint AS upto FROM cs WINDOW w AS (ORDER BY {draw_sql('1', "'batch'", str(EPOCH), 'node')}, node)),
nx AS MATERIALIZED (SELECT a.pos, min(b.pos) AS following FROM od a JOIN od b ON b.pos > a.pos AND b.upto > a.upto - a.cost + {CAP} GROUP BY 1),
st AS (SELECT 0::bigint AS batch, 1::bigint AS pos UNION ALL SELECT batch + 1, following FROM st JOIN nx USING (pos))
SELECT node, cost, (SELECT max(batch) FROM st WHERE st.pos <= od.pos) AS batch FROM od"""


_ADJ = "aj AS (SELECT src AS node, dst AS nbr FROM gc UNION SELECT dst, src FROM gc)"
_ROWS = f"r0 AS MATERIALIZED (SELECT node, nbr, row_number() OVER (ORDER BY node, nbr) - 1 AS r FROM aj), rw AS (SELECT node, nbr, r, r // {HUB} AS cut, nbr - lag(nbr) OVER (PARTITION BY node, r // {HUB} ORDER BY nbr) AS step FROM r0)"

SQL = {
    "negatives_dense_all": f"WITH {GS} {_FREE}",
    "negatives_dense_most": _MOST,
    "negatives_dense_pairs": f"WITH {GS} SELECT a.node AS src, b.node AS dst FROM sn a, sn b WHERE a.node < b.node AND (a.node, b.node) NOT IN (SELECT (src, dst) FROM gs) AND (b.node, a.node) NOT IN (SELECT (src, dst) FROM gs)",
    "negatives_per_node_dense": _PER_DENSE,
    "batch_pack_undir": _packed(GC, ("all",), "e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM gc),"),
    "batch_pack_sr": _packed(GE, ("all", "out", "in"), ""),
    "batch_pack_dr": _packed(GE, ("out", "in"), ""),
    "adjacency_blocks": f"WITH {GC}, {_ADJ}, {_ROWS} SELECT node, min(r) AS offset, count(*) AS n, min(nbr) AS first, coalesce(string_agg(step::varchar, ',' ORDER BY nbr), '') AS deltas FROM rw GROUP BY node, cut",
    "adjacency_pointers": f"WITH {GC}, {_ADJ}, {_ROWS} SELECT node, min(r) AS start, count(*) AS n FROM rw GROUP BY node",
    "adjacency_from_blocks": f"WITH {GC}, {_ADJ} SELECT node, nbr FROM aj",
    "temporal_split_ratio": f"WITH {GP}, p AS (SELECT src, dst, median(t)::double AS t FROM gp GROUP BY 1, 2), o AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM p) SELECT src, dst, t, CASE WHEN t < (SELECT t FROM o WHERE k = (SELECT greatest(1, floor(count(*) * 0.8::double)) FROM p)) THEN 'train' ELSE 'test' END AS part FROM p",
    "unseen_nodes_sparse": f"WITH {GC}, {split_sql('gc', 'round_even(count(*) * 0.02::double, 0)')}, k AS (SELECT src AS node FROM s WHERE part = 'train' UNION SELECT dst FROM s WHERE part = 'train') SELECT node FROM (SELECT src AS node FROM s WHERE part = 'test' UNION SELECT dst FROM s WHERE part = 'test') WHERE node NOT IN (SELECT node FROM k)",
    "split_contract_faults": f"""WITH {GC}, {per_node_sql()}, ps AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS row FROM gc JOIN srcs USING (src)),
cases AS (SELECT unnest(['none', 'negatives', 'order', 'degrees']) AS fault),
n AS (SELECT fault, src, dst, row FROM pn, cases WHERE fault <> 'negatives' OR row >= 1),
p AS (SELECT fault, src, dst, CASE WHEN fault = 'order' THEN -row ELSE row END AS row FROM ps, cases),
dg AS (SELECT fault, src, count(*) + CASE WHEN fault = 'degrees' THEN 1 ELSE 0 END AS d FROM ps, cases GROUP BY 1, 2),
nq AS (SELECT fault, src, count(*) AS q FROM n GROUP BY 1, 2), pq AS (SELECT fault, src, count(*) AS q FROM p GROUP BY 1, 2),
nl AS (SELECT fault, bool_and(src >= coalesce(before, src)) AS fine FROM (SELECT fault, src, lag(src) OVER (PARTITION BY fault ORDER BY row) AS before FROM n) GROUP BY 1),
pl AS (SELECT fault, bool_and(bs IS NULL OR bs < src OR (bs = src AND bd <= dst)) AS fine FROM (SELECT fault, src, dst, lag(src) OVER w AS bs, lag(dst) OVER w AS bd FROM p WINDOW w AS (PARTITION BY fault ORDER BY row)) GROUP BY 1)
SELECT fault, (SELECT count(*) FROM n WHERE n.fault = c.fault) = 20 * (SELECT count(*) FROM pq WHERE pq.fault = c.fault) AS sizes,
    (SELECT bool_and(coalesce(nq.q, 0) = 20) FROM pq LEFT JOIN nq ON nq.fault = pq.fault AND nq.src = pq.src WHERE pq.fault = c.fault) AND nl.fine AS blocks, pl.fine AS positives_sorted,
    (SELECT bool_and(dg.d = pq.q) FROM pq JOIN dg ON dg.fault = pq.fault AND dg.src = pq.src WHERE pq.fault = c.fault) AS degrees
FROM cases c JOIN nl USING (fault) JOIN pl USING (fault)""",
}
