"""Micro fixtures of the graph operators, and every query with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from treelink.operators import graph as g
from treelink.operators import metrics as m
from treelink.plans import catalog

SF = "/root/testdata/sf0.001"


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_dedup_and_degrees(spark):
    e = edges(spark, [(1, 2), (2, 1), (1, 2), (3, 3)])
    assert pairs(g.undirected(e)) == [(1, 2), (3, 3)]
    assert len(pairs(g.directed(e))) == 3
    assert pairs(g.degree(g.undirected(e))) == [(1, 1), (2, 1), (3, 2)]
    assert pairs(g.degree_distinct(g.directed(e))) == [(1, 1), (2, 1), (3, 1)]


def test_equal_scores(spark):
    s = spark.createDataFrame([(1, 0.5)] * 30 + [(0, 0.5)] * 30, "label int, score double")
    r = m.ranking_metrics(s).first()
    assert (r.roc_auc, r.hits20, r.hits50, r.mrr_opt) == (0.5, 0.5, 1.0, 1.0)
    assert r.mrr_pess == pytest.approx(1 / 31, abs=1e-9)


def test_empty_edges(spark):
    e = edges(spark, [])
    assert pairs(g.directed(e)) == [] and pairs(g.node_map(e)) == [] and pairs(g.random_split(e, 0.5)) == []


def test_negatives_are_no_edges(spark):
    e = edges(spark, [(i, (i * 7) % 40) for i in range(40)])
    got = pairs(g.negatives(e, 50))
    known = {tuple(sorted(x)) for x in pairs(e)}
    assert len(set(got)) == 50 and not known & set(got) and all(a < b for a, b in got)


def test_flagship_ranks_against_all_nodes(spark):
    sf = "/root/testdata/sf0.01"
    known = set(pairs(g.directed(catalog.ge(spark, sf))))
    got = catalog.sampled(spark, sf).filter("label = 0").select("src", "dst").collect()
    targets = {r.dst for r in got}
    assert catalog.FLAGSHIP == "ranking_metrics_sampled" and not known & set(map(tuple, got))
    assert len(set(map(tuple, got))) == len(got) == len(known) and len(targets) == 150 and len({r.src for r in got}) == 150


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = entry_module.queries()[name](spark, SF).toPandas(), con.execute(catalog.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    assert len(a) == len(b) and all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in cols)


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_thresholds_of_many_times(spark, n):
    """Against a sorted list, with ties."""
    times = [float((i * 7919) % (n // 2 + 1)) for i in range(n)]
    timed = spark.createDataFrame([(i, i + 1, t) for i, t in enumerate(times)], "src long, dst long, t double")
    ratios = [0.0, 0.25, 0.8, 1.0]
    got = g.temporal_thresholds(timed, ratios)
    assert dict(map(tuple, got.collect())) == ({r: sorted(times)[max(1, int(n * r)) - 1] for r in ratios} if n else {})
    split = g.temporal_split_at(timed, 0.8).filter("part = 'train'").count()
    assert split == (sum(t < sorted(times)[max(1, int(n * 0.8)) - 1] for t in times) if n else 0)


def test_thresholds_with_null_times(spark):
    timed = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 4, 5.0), (4, 5, 6.0)], "src long, dst long, t double")
    assert dict(map(tuple, g.temporal_thresholds(timed, [0.5, 0.75, 1.0]).collect())) == {0.5: None, 0.75: 5.0, 1.0: 6.0}
