"""Runs of several epochs and several models: resuming, sweeps, commands; formats of spark.read; ranks among many negatives; expected runs."""

import dataclasses
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelink import cli
from treelink.operators import graph as g
from treelink.operators import metrics as m
from treelink.operators import moves
from treelink.operators import training as t
from treelink.operators.order import transitions
from treelink.plans import train_queries
from treelink.scratch import CLEANUP, Scratch, read_file, temporary, write_text
from treelink.sources import results
from treelink.sources.formats import register_formats


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def pairs(df):
    return sorted(map(tuple, df.collect()))


GRAPH = [(i, (i * 7 + j) % 40) for i in range(40) for j in (1, 3, 9)]


@pytest.mark.parametrize("variant", ["dr"])
def test_a_lost_run_goes_on(spark, tmp_path, variant):
    e, cfg = edges(spark, GRAPH), t.TrainConfig(height=6, dims=3, epochs=2, seed=4)
    whole, history = t.train(e, cfg, variant)
    path = f"file://{tmp_path}/run"
    t.train(e, cfg, variant, resume=path, until=1)
    (tmp_path / "run" / "epoch-1").mkdir()  # left by a driver that was lost while it wrote
    model, again = t.train(e, cfg, variant, resume=path)
    for name, v in whole.vectors.items():
        assert pairs(v) == pairs(model.vectors[name])
    assert again == history and [r["epoch"] for r in again] == [0, 1]
    done, same = t.train(e, cfg, variant, resume=path)
    assert same == history and pairs(done.vectors[name]) == pairs(whole.vectors[name])
    assert sorted(p.name for p in (tmp_path / "run").iterdir() if p.name.startswith("epoch")) == ["epoch-1"]
    with pytest.raises(ValueError):
        t.train(e, dataclasses.replace(cfg, seed=5), variant, resume=path)


def test_small_files(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    assert read_file(spark, path) is None
    for text in ('{"a":\n 1}', "second é"):
        write_text(spark, path, text)
        assert read_file(spark, path) == text


def test_history_is_of_the_write(spark):
    """Losses of the history are means over nodes, as counted on the moved nodes themselves."""
    e, cfg = edges(spark, GRAPH), t.TrainConfig(height=6, dims=3, epochs=1, seed=4)
    _, history = t.train(e, cfg, "undir")
    u = g.undirected(e)
    ids = g.node_map(u)
    moved = t.step(t.start(u, cfg, "undir"), t.links_of(u, "undir"), ids, ids.count(), 0)["z"]
    assert history[0]["loss"] == pytest.approx(moved.agg(F.avg("loss")).first()[0])


def test_sweep_at_once(spark):
    e, cfg = edges(spark, GRAPH), t.TrainConfig(height=5, dims=2, epochs=1)
    one, two = (t.sweep_grid(e, [0.5, 0.7], [1], cfg, at_once=n).orderBy("ratio", "seed").collect() for n in (1, 3))
    assert one == two and [(r.ratio, r.seed) for r in one] == [(0.5, 1), (0.7, 1)]
    assert spark.conf.get(CLEANUP, "false") == "false"


def test_temporary_tables_are_of_their_thread(spark):
    kept, ready, go = [], threading.Event(), threading.Event()

    def other():
        kept.append(Scratch(spark, "other").save(spark.range(5), "x"))
        ready.set()
        go.wait(60)

    th = threading.Thread(target=other)
    with temporary():
        th.start()
        ready.wait(60)
    assert kept[0].count() == 5
    go.set()
    th.join()


@pytest.mark.parametrize("variant, oi, block, rows", [("sr", 1, 7, 10), ("dr", 0, 1000, 1000), ("undir", 1, 16, 50)])
def test_ranks_among_many_negatives(spark, variant, oi, block, rows):
    e = g.undirected(edges(spark, GRAPH)) if variant == "undir" else g.directed(edges(spark, GRAPH))
    cfg = t.TrainConfig(height=6, dims=3, oi=oi)
    model, ids = t.start(e, cfg, variant), g.node_map(e)
    want = m.node_mrr(e, lambda p: model.score(p).withColumn("score", F.round("score", 9)), ids, ids.count(), 30)
    assert m.node_mrr_blocks(e, model, ids, ids.count(), 30, block=block, rows=rows).first() == want.first()


def test_expected_runs(spark):
    runs = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.5)], "dataset string, turn int, x double")
    full = m.run_grid(runs, ["dataset"], "turn", [0, 1])
    assert full.count() == 4
    text = lambda zero: {r.dataset: r.x for r in m.run_summary(full, ["dataset"], ["x"], zero).collect()}
    assert text(False) == {"a": "60.00±10.00", "b": "50.00±0.00"} and text(True)["b"] == "25.00±25.00"


def test_formats(spark, tmp_path):
    register_formats(spark)
    array = np.array([[i, i * i] for i in range(50)], np.int32)
    np.save(tmp_path / "long.npy", array)
    np.save(tmp_path / "wide.npy", array.T.copy().astype(np.uint16))
    (tmp_path / "a.txt").write_text("".join(f"{i} 0 {i + 1} {i * 2}\n" for i in range(300)) + "short line\n7 1 8 9")
    (tmp_path / "b.txt").write_text("\n5 0 6 7 0 0\n\n")
    for name in ("long", "wide"):
        d = spark.read.format("edge_npy").option("size", 7).load(f"{tmp_path}/{name}.npy")
        assert d.rdd.getNumPartitions() == 8 and pairs(d) == [(i, i * i) for i in range(50)]
        assert pairs(d.filter("dst > 100 and src < 20 and src % 2 = 0")) == [(i, i * i) for i in range(12, 20, 2)]
    for size in (64, 1000, 1 << 20):
        f = spark.read.format("temporal_facts").option("paths", f"{tmp_path}/a.txt,{tmp_path}/b.txt").option("size", size).load()
        want = sorted([(i, 0, i + 1, i * 2) for i in range(300)] + [(7, 1, 8, 9), (5, 0, 6, 7)])
        assert pairs(f) == want
        assert pairs(f.filter("t >= 100").select("t")) == sorted((x[3],) for x in want if x[3] >= 100)
    with pytest.raises(Exception):
        np.save(tmp_path / "bad.npy", np.zeros((3, 3)))
        spark.read.format("edge_npy").load(f"{tmp_path}/bad.npy").count()


def test_commands(spark, tmp_path):
    edges(spark, GRAPH).write.parquet(f"{tmp_path}/e")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("prepare", "--input", f"{tmp_path}/e", "--out", f"{tmp_path}/s", "--split-ratio", 0.7, "--neg-ratio", 1, "--text", "normal")
    assert spark.read.csv(f"{tmp_path}/s/0.7/text/train", sep="\t").count() > 20
    for turn in (0, 1):
        run("train", "--data", f"{tmp_path}/s/0.7", "--split-ratio", 0.7, "--metrics", f"{tmp_path}/m", "--turn", turn, "--seed", turn, "--epochs", 1, "--height", 5, "--dims", 2, "--save-score", f"{tmp_path}/sc", "--save-model", f"{tmp_path}/mo", "--history", f"{tmp_path}/h", "--resume", f"file://{tmp_path}/r{turn}")
    run("report", "--metrics", f"{tmp_path}/m", "--out", f"{tmp_path}/rep", "--turns", 0, 1, 2)
    assert results.read_model(spark, f"{tmp_path}/mo").cfg.height == 5 and spark.read.parquet(f"{tmp_path}/sc").count() > 4
    assert results.read_metrics(spark, f"{tmp_path}/rep").count() == 1 and spark.read.parquet(f"{tmp_path}/h").count() == 1


def test_summary_rounds_exact_values(spark):
    """Ties of what is printed go to even, and 1.005 is less than it looks."""
    d = spark.createDataFrame([(1, 0.50125), (2, 0.50375), (3, 0.01005), (4, None)], "dataset long, auc double")
    got = {r.dataset: r.auc for r in m.run_summary(d, ["dataset"], ["auc"]).collect()}
    assert got == {i: f"{x * 100:.2f}±0.00" for i, x in ((1, 0.50125), (2, 0.50375), (3, 0.01005))} | {4: None}
    assert got[1] == "50.12±0.00"


def test_counters_are_those_of_each_text():
    """All draws of many keys at once: short and long texts, of more than a digest's block too."""
    heads = [f"1|nm|{x}|" for x in (0, 7, 12345, 10**18)] + ["9" * 60 + "|"]
    tails = [f"{i}|{i * i}" for i in (0, 3, 10, 999, 10**9)]
    assert moves.counters(heads, tails).tolist() == [[moves.counter(h + t) for t in tails] for h in heads]


def test_negatives_stay_in_the_task_that_draws_them(spark, monkeypatch):
    """node_mrr_1000 sends nodes to slices of edges and no lists of negatives: its rows between are two a node and slice or edge."""
    seen, events = [], spark.createDataFrame([(i, i, i * i % 211) for i in range(400)], "event_id long, ts long, user_id long")
    monkeypatch.setattr(train_queries, "ge", lambda *_: transitions(events, ["ts", "event_id"], "user_id"))
    monkeypatch.setattr(m.Scratch, "save", lambda self, df, name: seen.append(df) or df)
    train_queries.node_mrr_many(spark, "")
    plan = next(d for d in seen if d.columns == ["src", "dst", "above", "upto"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "drawn" not in plan
