"""Links in bucketed tables: what a step reads of them equals plain joins, links stay where they are, batches read their own."""

import re

import pytest
from pyspark.sql import functions as F

from treelink.operators import graph as g
from treelink.operators import order
from treelink.operators import training as t
from treelink.operators.layout import in_batches, lay, messages
from treelink.operators.order import transitions
from treelink.plans import train_queries
from treelink.scratch import Scratch, temporary

#: A hub (0), a chain and a node (90) that only receives.
GRAPH = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 30)] + [(5, 90), (6, 90), (17, 0), (18, 0)]
OPPOSITE = {"z": "z", "head": "tail", "tail": "head"}


@pytest.fixture
def setting(spark):
    def made(variant, **changed):
        e = spark.createDataFrame(GRAPH, "src long, dst long")
        e = g.undirected(e) if variant == "undir" else g.directed(e)
        cfg = t.TrainConfig(height=6, dims=3, epochs=2, seed=3, mask_share=0.5, **changed)
        ids = g.node_map(e)
        return t.start(e, cfg, variant), t.links_of(e, variant), ids, ids.count()

    return made


@pytest.mark.parametrize("variant", ["undir", "sr", "dr"])
@pytest.mark.parametrize("hub,epoch", [(4096, 1), (3, 1), (3, 2)])
def test_messages_are_those_of_plain_joins(setting, variant, hub, epoch):
    model, links, ids, n = setting(variant)
    laid = lay(links, ids, model.deg, variant, hub)
    columns = ["node", "nbr", "key", "y", "cnt", "z", F.round("n12", 9), F.round("n21", 9)]
    for name, rows in t.branches(links, ids, n, model.cfg, epoch, variant).items():
        ends = (model.vectors[name], model.vectors[OPPOSITE[name]])
        want = t.with_ends(rows, *ends, model.deg).withColumnRenamed("z2", "z").select(*columns)
        got = messages(laid, name, *ends, n, model.cfg, epoch)
        assert sorted(map(str, got.filter("y >= 0").select(*columns).collect())) == sorted(map(str, want.collect()))
        own = got.filter("y < 0").select("node", "part", "parts", "z").collect()
        places = {r.node: r.z for r in ends[0].collect()}
        assert len({(r.node, r.part) for r in own}) == len(own) and all(r.z == places[r.node] and 0 <= r.part < r.parts for r in own)
        assert {(r.node, r.part, r.parts) for r in got.filter("y >= 0").collect()} <= {(r.node, r.part, r.parts) for r in own}
        assert max(r.n for r in got.filter("y >= 0").groupBy("node", "part").agg(F.count("*").alias("n")).collect()) < (2 * len(GRAPH) if hub > 3 else 40)


def test_links_are_not_shuffled(spark, setting, monkeypatch):
    """Between the scan of links by neighbour and the join with coordinates there is no Exchange, and after it one."""
    model, links, ids, n = setting("undir")
    scratch = Scratch(spark, "plan")
    z = scratch.bucketed(model.vectors["z"], "z", ["node"])
    laid = lay(links, ids, model.deg, "undir", 4096, scratch)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = messages(laid, "z", z, z, n, model.cfg, 1).repartition("node", "part")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if scratch.tables["far-all"] in x and "FileScan" in x)
    depth = lambda x: re.search(r"[A-Za-z*]", x).start()
    above, now = [], depth(lines[at])
    for x in reversed(lines[:at]):  # the operators between the scan and the root
        if depth(x) < now:
            above.append(x.strip(" :+-"))
            now = depth(x)
    join = next(i for i, x in enumerate(above) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in above[:join]) and sum("Exchange" in x for x in above[join:]) == 1
    scratch.end()


@pytest.mark.parametrize("variant", ["undir", "dr"])
def test_steps_by_batch(spark, setting, variant):
    """Batches laid apart move each node as a step over all links does, and each reads its own links only."""
    model, links, ids, n = setting(variant)
    scratch = Scratch(spark, "batches")
    laid = lay(links, ids, model.deg, variant, 4096, scratch)
    plan = t.batch_pack(links, model.cfg, 1, 20)
    now = in_batches(laid, plan, 1, scratch)
    batches = sorted(r.batch for r in plan.select("batch").distinct().collect())
    place = lambda moved: {(k, r.node): (r.z, round(r.loss, 9)) for k, m in moved.items() for r in m.collect()}
    want, got = place(t.step(model, laid, ids, n, 1)), {}
    for b in batches:
        one = place(t.step(model, now, ids, n, 1, b))
        assert not set(one) & set(got)
        got |= one
    assert len(batches) > 2 and got == want
    kind = next(iter(now.far))
    files = now.far[kind].filter(F.col("batch") == 0).inputFiles()
    assert files and len(files) < len(now.far[kind].inputFiles())
    now.drop(scratch)
    assert not spark.catalog.tableExists(scratch.tables.get(f"far-{kind}-1", "none"))


def test_bucketed_tables_go_with_their_block(spark):
    before = {x.name for x in spark.catalog.listTables()}
    with temporary():
        kept = Scratch(spark, "bucketed").bucketed(spark.range(50).withColumn("v", F.col("id") * 2), "a", ["id"])
        assert kept.agg(F.sum("v")).first()[0] == 2450 and len({x.name for x in spark.catalog.listTables()} - before) == 1
    assert {x.name for x in spark.catalog.listTables()} == before


def test_losses_in_more_tasks_when_rows_are_more(spark, monkeypatch):
    """Tasks of the losses grow in number with the links, and the losses stay as they are."""
    e = spark.createDataFrame(GRAPH, "event_id long, user_id long").selectExpr("monotonically_increasing_id() as event_id", "event_id as ts", "user_id")
    monkeypatch.setattr(train_queries, "ge", lambda *_: transitions(e, ["ts", "event_id"], "user_id", e.count()))
    few, seen = train_queries.loss_terms(spark, "").collect(), []
    monkeypatch.setattr(order, "TASK_ROWS", 8)
    rows = train_queries.t.with_ends
    monkeypatch.setattr(train_queries.t, "with_ends", lambda *a: seen.append(a[-1]) or rows(*a))
    more = train_queries.loss_terms(spark, "").collect()
    near = lambda got: sorted((r.node, round(r.pos, 9), round(r.neg, 9)) for r in got)
    assert near(few) == near(more) and seen[0] > 8
