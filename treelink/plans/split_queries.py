"""Queries of preparation, splits and negative samples beyond those of the catalog, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cosine
from ..operators import graph as g
from ..operators.order import numbered
from ..scratch import Scratch
from .fixtures import GC, GE, ND, draw_sql, gc, ge, split_sql, table


def halves(spark: SparkSession, d: str, rounding: str = "round") -> DataFrame:
    return g.random_split(g.directed(gc(spark, d)), 0.5, seed=1, rounding=rounding)


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Train and transductive test of GC."""
    s = Scratch(spark, "parts").save(halves(spark, d), "split")
    train = s.filter("part = 'train'").select("src", "dst")
    return train, g.transductive(s.filter("part = 'test'"), train)


def split_remap(spark: SparkSession, d: str) -> DataFrame:
    s = halves(spark, d)
    return g.remap(s.filter("part = 'test'"), g.node_map(s.filter("part = 'train'"))).select("src", "dst")


def unseen(spark: SparkSession, d: str) -> DataFrame:
    s = halves(spark, d)
    return g.unseen_nodes(s.filter("part = 'test'"), g.nodes(s.filter("part = 'train'")))


def active(spark: SparkSession, d: str) -> DataFrame:
    """Sources of GC with out-links, among all its nodes."""
    e = g.directed(gc(spark, d))
    return g.active_nodes(g.nodes(e), g.degree_out_in(e).select("node", "out_degree"))


def features(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("node"), F.col("embedding")[0].cast("double").alias("x0"), F.col("embedding")[1].cast("double").alias("x1"))
    ids = g.node_map(ge(spark, d))
    return g.gather_features(ids, v)


def negatives_strict_ratio(spark: SparkSession, d: str) -> DataFrame:
    train, test = parts(spark, d)
    return g.negatives_for(train, test, ratio=5, seed=3)


def negatives_ordered(spark: SparkSession, d: str) -> DataFrame:
    e = g.directed(gc(spark, d))
    return g.negatives(e, 2000, seed=3, strict=False)


def negatives_with_loops(spark: SparkSession, d: str) -> DataFrame:
    e = g.directed(gc(spark, d))
    return g.negatives(e, 2000, seed=5, strict=False, loops=True)


def sources(spark: SparkSession, d: str) -> DataFrame:
    return g.nodes(gc(spark, d)).filter("node % 10 = 3 and node < 1000000000")  # which sources are tested is an input


def negatives_per_node(spark: SparkSession, d: str) -> DataFrame:
    return g.negatives_per_node(gc(spark, d), sources(spark, d), 20, seed=4)


def contract_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positives, negatives and degrees of GC, saved, as the check reads each of them several times."""
    scratch = Scratch(spark, "contract")
    e = scratch.save(g.directed(gc(spark, d)), "edges")
    asked = sources(spark, d).withColumnRenamed("node", "src")
    pos = scratch.save(g.sorted_edges(e.join(asked, "src", "left_semi")), "positives")
    neg = scratch.save(negatives_per_node(spark, d), "negatives")
    return pos, neg, scratch.save(g.test_degree(g.nodes(e), pos), "degrees")


def contract(spark: SparkSession, d: str) -> DataFrame:
    return g.contract(*contract_parts(spark, d), 20)


def directed_split(spark: SparkSession, d: str) -> DataFrame:
    made = g.directed_split(ge(spark, d), 0.5, 1, seed=1)
    out = [df.select("src", "dst", F.lit(name).alias("part")) for name, df in made.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the order of vec_id within each label."""
    v = numbered(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label", "vec_id"], "row")
    b = v.select("label", (F.col("row") - 1).alias("row"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return v.join(b, ["label", "row"]).select(F.col("vec_id").alias("a"), "b", F.round(cosine(F.col("embedding"), F.col("eb")), 6).alias("score"))


QUERIES = {
    "degree_total": lambda s, d: g.degree_total(g.directed(ge(s, d))),
    "active_nodes": active,
    "split_floor": lambda s, d: halves(s, d, "floor"),
    "split_stats": lambda s, d: g.split_stats(Scratch(s, "stats").save(halves(s, d), "split")),
    "split_remap": split_remap,
    "unseen_nodes": unseen,
    "edges_sorted": lambda s, d: g.sorted_edges(g.directed(ge(s, d))),
    "valid_stub": lambda s, d: g.valid_stub(halves(s, d).filter("part = 'train'")),
    "feature_gather": features,
    "negatives_ratio": negatives_strict_ratio,
    "negatives_ordered": negatives_ordered,
    "negatives_with_loops": negatives_with_loops,
    "negatives_per_node": negatives_per_node,
    "split_contract_check": contract,
    "directed_split": directed_split,
    "cosine_pairs": cosine_pairs,
}

_S = f"WITH {GC}, {split_sql('gc')}"
_K = "k AS (SELECT src AS node FROM s WHERE part = 'train' UNION SELECT dst FROM s WHERE part = 'train')"
_TEST = "test AS (SELECT src, dst FROM s WHERE part = 'test' AND src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k))"


def negatives_sql(nodes: str, taken: str, num: str, seed: int, strict: bool, loops: bool = False, times: int = 64) -> str:
    """CTEs ix, draws, free and neg: the first draws that are free. nodes and taken: queries of the nodes and of the pairs to avoid; times: how often the first number of draws is made, 64 where free pairs may be few."""
    pair = "least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst" if strict else "a.node AS src, b.node AS dst"
    avoid = f"(SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({taken}))" if strict else f"({taken})"
    return f"""ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM ({nodes})), nn AS (SELECT count(*) AS n FROM ix),
want AS MATERIALIZED ({num}), draws AS (SELECT id, {draw_sql(str(seed), "'x'", "id")} % n AS i, {draw_sql(str(seed), "'y'", "id")} % n AS j FROM (SELECT unnest(range((SELECT {times} * (2 * num + 16) FROM want))) AS id), nn),
free AS (SELECT {pair}, min(id) AS id FROM draws JOIN ix a ON a.idx = i JOIN ix b ON b.idx = j {'' if loops else 'WHERE i <> j'} GROUP BY 1, 2),
neg AS (SELECT src, dst FROM free ANTI JOIN {avoid} x USING (src, dst) ORDER BY id LIMIT (SELECT num FROM want))"""


_GCN = "SELECT src AS node FROM gc UNION SELECT dst FROM gc"
_PER_NODE = f"""ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM ({_GCN})), nn AS (SELECT count(*) AS n FROM ix),
srcs AS (SELECT node AS src FROM ix WHERE node % 10 = 3 AND node < 1000000000),
dr AS (SELECT src, i, {draw_sql("4", "'pn'", "src", "i")} % n AS idx FROM srcs, (SELECT unnest(range(80)) AS i), nn),
ok AS (SELECT src, node AS dst, min(i) AS i FROM dr JOIN ix USING (idx) WHERE src <> node GROUP BY 1, 2),
fr AS (SELECT src, dst FROM ok ANTI JOIN gc USING (src, dst) QUALIFY row_number() OVER (PARTITION BY src ORDER BY i) <= 20),
pn AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS row FROM fr)"""



def per_node_sql() -> str:
    """CTEs up to pn: the negatives of negatives_per_node."""
    return _PER_NODE


SQL = {
    "degree_total": f"WITH {GE} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1",
    "active_nodes": f"WITH {GC} SELECT DISTINCT src AS node FROM gc",
    "split_floor": f"WITH {GC}, {split_sql('gc', 'floor(count(*) * 0.5::double)')} SELECT * FROM s",
    "split_stats": f"{_S}, {_K}, c AS (SELECT count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'test') AS n_test, (SELECT count(*) FROM k) AS n_nodes FROM s) SELECT n_train, n_test, n_nodes, round(n_test / n_train::double, 9) AS test_per_train, round(n_train / n_nodes::double, 9) AS edges_per_node FROM c",
    "split_remap": f"{_S}, {_K}, m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM k) SELECT coalesce(a.idx, -1)::bigint AS src, coalesce(b.idx, -1)::bigint AS dst FROM s LEFT JOIN m a ON a.node = src LEFT JOIN m b ON b.node = dst WHERE part = 'test'",
    "unseen_nodes": f"{_S}, {_K} SELECT node FROM (SELECT src AS node FROM s WHERE part = 'test' UNION SELECT dst FROM s WHERE part = 'test') WHERE node NOT IN (SELECT node FROM k)",
    "edges_sorted": f"WITH {GE} SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS row FROM e",
    "valid_stub": f"{_S} SELECT src, dst FROM s WHERE part = 'train' ORDER BY src, dst LIMIT 2",
    "feature_gather": f"WITH {GE}, {ND}, m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nd) SELECT idx, embedding[1]::double AS x0, embedding[2]::double AS x1 FROM m LEFT JOIN embeddings ON vec_id = node",
    "negatives_ratio": f"{_S}, {_K}, {_TEST}, {negatives_sql('SELECT node FROM k', 'SELECT src, dst FROM s WHERE part = $$train$$ UNION ALL SELECT src, dst FROM test'.replace('$$', chr(39)), 'SELECT count(*) * 5 AS num FROM test', 3, True, times=4)} SELECT src, dst FROM neg",
    "negatives_ordered": f"WITH {GC}, {negatives_sql(_GCN, 'SELECT src, dst FROM gc', 'SELECT 2000 AS num', 3, False)} SELECT src, dst FROM neg",
    "negatives_with_loops": f"WITH {GC}, {negatives_sql(_GCN, 'SELECT src, dst FROM gc', 'SELECT 2000 AS num', 5, False, True)} SELECT src, dst FROM neg",
    "negatives_strict": f"WITH {GC}, {negatives_sql(_GCN, 'SELECT src, dst FROM gc', 'SELECT 2000 AS num', 3, True)} SELECT src, dst FROM neg",
    "negatives_per_node": f"WITH {GC}, {_PER_NODE} SELECT src, dst, row FROM pn",
    "split_contract_check": f"""WITH {GC}, {_PER_NODE}, pos AS (SELECT src, count(*) AS p FROM gc JOIN srcs USING (src) GROUP BY 1), q AS (SELECT src, count(*) AS q FROM pn GROUP BY 1),
po AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS row FROM gc JOIN srcs USING (src)), dg AS (SELECT src, count(*) AS d FROM po GROUP BY 1)
SELECT (SELECT count(*) FROM pn) = 20 * count(*) AS sizes, bool_and(coalesce(q, 0) = 20) AS blocks,
    (SELECT bool_and(bs IS NULL OR bs < src OR (bs = src AND bd <= dst)) FROM (SELECT src, dst, lag(src) OVER (ORDER BY row) AS bs, lag(dst) OVER (ORDER BY row) AS bd FROM po)) AS positives_sorted, bool_and(d = p) AS degrees FROM pos LEFT JOIN q USING (src) LEFT JOIN dg USING (src)""",
    "directed_split": f"""WITH {GE}, {split_sql('e')}, {_K}, {_TEST}, {negatives_sql('SELECT node FROM k', 'SELECT src, dst FROM s WHERE part = $$train$$ UNION ALL SELECT src, dst FROM test'.replace('$$', chr(39)), 'SELECT count(*) AS num FROM test', 1, False)}
SELECT src, dst, 'train' AS part FROM s WHERE part = 'train' UNION ALL SELECT src, dst, 'test_pos' FROM test UNION ALL SELECT src, dst, 'test_neg' FROM neg""",
    "cosine_pairs": "WITH v AS (SELECT label, vec_id, embedding, lead(vec_id) OVER w AS b, lead(embedding) OVER w AS eb FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id AS a, b, round(list_cosine_similarity(embedding::double[], eb::double[]), 6) AS score FROM v WHERE b IS NOT NULL",
}
