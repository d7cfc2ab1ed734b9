"""Training: quality on planted blocks, hubs summed by parts, portable steps; sources, sinks and the registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelink.functions.columns import SELECTORS, bit_length, selected
from treelink.operators import graph as g
from treelink.operators import metrics as m
from treelink.operators import training as t
from treelink.operators.order import numbered, prefix_sums, transitions
from treelink.sources import edges as se
from treelink.sources import registry, results


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def block_graph(spark, seed, nodes=200, blocks=10, per_node=12):
    """Undirected edges mostly within blocks, cut into train and test pairs with labels."""
    rng = np.random.default_rng(seed)
    of, made = np.arange(nodes) % blocks, set()
    while len(made) < nodes * per_node // 2:
        a = int(rng.integers(nodes))
        mates = np.flatnonzero(of == of[a]) if rng.random() < 0.98 else np.arange(nodes)
        b = int(rng.choice(mates))
        if a != b:
            made.add((min(a, b), max(a, b)))
    all_pairs = sorted(made)
    rng.shuffle(all_pairs)
    cut = len(all_pairs) * 3 // 4
    train, test = [tuple(map(int, x)) for x in all_pairs[:cut]], [tuple(map(int, x)) for x in all_pairs[cut:]]
    known = {x for e in train for x in e}
    test, no = [e for e in test if set(e) <= known], set()
    while len(no) < len(test):
        a, b = sorted(map(int, rng.choice(sorted(known), 2, replace=False)))
        if (a, b) not in made:
            no.add((a, b))
    return edges(spark, train), spark.createDataFrame([(*e, 1) for e in test] + [(*e, 0) for e in sorted(no)], "src long, dst long, label int")


@pytest.mark.parametrize("seed", [1, 2])
def test_training_ranks_better_than_the_start(spark, seed):
    train, test = block_graph(spark, seed)
    cfg = t.TrainConfig(height=8, dims=16, alpha=8.0, epochs=6, seed=seed, eval_step=6)
    before = t.evaluate(t.start(g.undirected(train), cfg, "undir"), test)["roc_auc"]
    model, history = t.train(train, cfg, "undir", test)
    assert len(history) == 6 and history[-1]["loss"] < history[0]["loss"] and "roc_auc" not in history[0]
    assert history[-1]["roc_auc"] > max(0.6, before + 0.1) and history[-1]["roc_auc"] == t.evaluate(model, test)["roc_auc"]


@pytest.mark.parametrize("variant", ["sr", "dr"])
def test_directed_training_ranks_better_than_the_start(spark, variant):
    train, test = block_graph(spark, 3)
    cfg = t.TrainConfig(height=8, dims=16, alpha=8.0, epochs=6)
    before = t.evaluate(t.start(g.directed(train), cfg, variant), test)["roc_auc"]
    model, history = t.train(train, cfg, variant, test)
    assert history[-1]["roc_auc"] > before + 0.05 and set(model.vectors) == ({"head", "tail"} if variant == "dr" else {"z"})


def test_hubs_by_parts(spark, monkeypatch):
    e = g.undirected(edges(spark, [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 30)]))
    cfg = t.TrainConfig(height=6, dims=3, epochs=2)
    model, links = t.start(e, cfg, "undir"), t.links_of(e, "undir")
    ids = g.node_map(e)
    got = []
    for hub in (4096, 5):
        monkeypatch.setattr(t, "HUB", hub)
        got.append({r.node: (r.z, round(r.loss, 9)) for r in t.step(model, links, ids, ids.count(), 2)["z"].collect()})
    assert got[0] == got[1] and len(got[0]) == 40


def test_batches_of_an_epoch(spark):
    e = g.undirected(edges(spark, [(i, (i * 7 + 1) % 30) for i in range(30)]))
    _, history = t.train(e, t.TrainConfig(height=5, dims=2, epochs=1, edge_cap=20), "undir")
    assert len(history) == 1 and history[0]["loss"] > 0


def test_defaults():
    assert (t.DEFAULTS["undir"].height, t.DEFAULTS["sr"].c, t.DEFAULTS["dr"].epochs) == (17, 2, 50)
    assert t.TrainConfig(height=15, c=2).candidates == 15 * 30 + 1


def test_selectors(spark):
    assert [selected(k, 0.25, 0.5) for k in SELECTORS] == [0.25, 0.5, 0.75, 0.5, 0.375]
    with pytest.raises(ValueError):
        selected("other", 0.1, 0.2)


def test_bit_length(spark):
    values = [0, 1, 2, 3, 4, *[(1 << k) + d for k in range(3, 52) for d in (-1, 0, 1)]]
    got = spark.createDataFrame([(v,) for v in values], "x long").select("x", bit_length(F.col("x")).alias("n")).collect()
    assert all(r.n == r.x.bit_length() for r in got)


def test_orders(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), F.lit(2).cast("long").alias("v"))
    got = numbered(d.repartition(7), ["x"], "n").orderBy("x").collect()
    assert [r.n for r in got] == list(range(1000))
    got = prefix_sums(d, [F.desc("x")], {"s": F.col("v")}).orderBy(F.desc("x")).collect()
    assert [r.s for r in got] == list(range(0, 2000, 2))
    e = spark.createDataFrame([(i, i * i) for i in range(50)], "t long, user long").repartition(5)
    assert pairs(transitions(e, ["t"], "user")) == [(i * i, (i + 1) ** 2) for i in range(49)]


def test_random_split_sizes(spark):
    e = edges(spark, [(i, i + 1) for i in range(25)])
    for ratio, rounding, want in ((0.5, "round", 12), (0.5, "floor", 12), (0.9, "floor", 22), (1.0, "round", 25), (0.0, "round", 0)):
        assert g.random_split(e, ratio, rounding=rounding).filter("part = 'train'").count() == want


def test_negatives_fall_short(spark, caplog):
    e = edges(spark, [(i, j) for i in range(6) for j in range(6) if i != j and (i, j) != (2, 5)])
    assert pairs(g.negatives(e, 10, strict=False)) == [(2, 5)] and "1 of 10" in caplog.text


def test_containment_and_schema(spark):
    e, known = edges(spark, [(1, 2)]), edges(spark, [(1, 2), (2, 3)])
    g.check_contained(e, e, g.nodes(known))
    with pytest.raises(ValueError):
        g.check_contained(e, edges(spark, [(1, 9)]), g.nodes(known))
    with pytest.raises(ValueError):
        g.check_edges(spark.createDataFrame([("a", 1)], "src string, dst long"))
    assert g.check_edges(e) is e


def test_contract_sees_faults(spark):
    rows = lambda x: spark.createDataFrame(x, "src long, dst long, row long")
    pos, neg = [(1, 2, 0), (2, 3, 1)], [(1, 5, 0), (1, 6, 1), (2, 5, 2), (2, 6, 3)]
    deg = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "node long, test_degree long")
    assert tuple(g.contract(rows(pos), rows(neg), deg, 2).first()) == (True, True, True, True)
    assert tuple(g.contract(rows(pos), rows(neg[:3]), deg, 2).first())[:2] == (False, False)
    assert tuple(g.contract(rows([(2, 3, 0), (1, 2, 1)]), rows(neg), deg, 2).first())[2] is False


def test_sources(spark, tmp_path):
    e = edges(spark, [(1, 2), (3, 4), (5, 6)])
    se.write_text(e, f"{tmp_path}/a")
    se.write_text(e, f"{tmp_path}/b", weighted=True)
    assert pairs(se.read_text(spark, f"{tmp_path}/a")) == pairs(se.read_text(spark, f"{tmp_path}/b")) == [(1, 2), (3, 4), (5, 6)]
    assert sorted(r.label for r in se.read_labelled(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()) == [0, 0, 0, 1, 1, 1]
    (tmp_path / "c.csv").write_text("x,source,target\n9,1,2\n9,3,4\n")
    array = np.array([[1, 3, 5], [2, 4, 6]], np.int32)
    np.save(tmp_path / "wide.npy", array)
    np.save(tmp_path / "long.npy", array.T.copy().astype(np.int64))
    for name in ("wide", "long"):
        assert pairs(se.read_npy(spark, f"{tmp_path}/{name}.npy", rows_per_range=2)) == [(1, 2), (3, 4), (5, 6)]
    (tmp_path / "facts1").write_text("1 0 2 5\n1 1 2 9\n")
    (tmp_path / "facts2").write_text("1 0 2 7\n3 0 4 1\n")
    registry.register("csv-edges", "csv", "c.csv")
    registry.register_temporal("facts", ["facts1", "facts2"])
    assert pairs(registry.load(spark, "csv-edges", str(tmp_path))) == [(1, 2), (3, 4)]
    assert pairs(registry.load(spark, "facts_median", str(tmp_path))) == [(1, 2, 7.0), (3, 4, 1.0)]
    with pytest.raises(ValueError):
        registry.load(spark, "none", "")


def test_bundle(spark, tmp_path):
    train, test = edges(spark, [(10, 20), (20, 30)]), edges(spark, [(10, 30)])
    x = spark.createDataFrame([(10, 0.5), (99, 1.5)], "node long, x double")
    se.write_bundle(train, test, edges(spark, [(30, 77)]), str(tmp_path / "b"), x)
    assert pairs(se.read_bundle(spark, str(tmp_path / "b"), "train")) == [(0, 1), (1, 2)]
    assert pairs(se.read_bundle(spark, str(tmp_path / "b"), "test_neg")) == [(2, -1)]
    assert pairs(spark.read.parquet(str(tmp_path / "b/test_degree"))) == [(0, 1), (1, 0), (2, 0)]
    assert sorted((r.idx, r.x) for r in spark.read.parquet(str(tmp_path / "b/features")).collect()) == [(0, 0.5), (1, None), (2, None)]


def test_results(spark, tmp_path):
    e = g.directed(edges(spark, [(1, 2), (2, 3), (3, 1)]))
    model = t.start(e, t.TrainConfig(height=4, dims=2), "dr")
    results.write_model(model, str(tmp_path / "m"))
    back = results.read_model(spark, str(tmp_path / "m"))
    test = e.withColumn("label", F.lit(1))
    assert back.cfg == model.cfg and pairs(back.score(test)) == pairs(model.score(test))
    results.write_scores(model.score(test), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    for turn, auc in ((1, 0.5), (2, 0.7)):
        results.write_metrics(spark, [{"dataset": "a", "ratio": 0.5, "turn": turn, "roc_auc": auc}], str(tmp_path / "r"))
    runs = results.read_metrics(spark, str(tmp_path / "r"))
    results.write_summary(runs, ["dataset", "ratio"], ["roc_auc"], str(tmp_path / "sum"))
    assert results.read_metrics(spark, str(tmp_path / "sum")).first().roc_auc == "60.00±10.00"
    results.write_history(spark, [{"epoch": 0, "loss": 1.0}, {"epoch": 1, "loss": 0.5, "roc_auc": 0.6}], str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).filter("roc_auc is null").count() == 1
    assert t.dropped_pairs(edges(spark, [(1, 2), (1, 9)]), model.vectors["head"]) == 1


def test_metric_switch_and_missing_runs(spark):
    s = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, score double")
    own = spark.createDataFrame([(0.25, 0.125)], "mrr_opt double, mrr_pess double")
    assert m.all_metrics(s).first().mrr_opt == 1.0 and m.all_metrics(s, own).first().mrr_opt == 0.25
    runs = spark.createDataFrame([("a", 0.5), ("a", None)], "d string, x double")
    assert m.run_summary(runs, ["d"], ["x"]).first().x == "50.00±0.00" and m.run_summary(runs, ["d"], ["x"], True).first().x == "25.00±25.00"


def test_sweep(spark):
    train, test = block_graph(spark, 5, nodes=60)
    rows = t.sweep([({"seed": s}, train, test, t.TrainConfig(height=5, dims=2, epochs=1, seed=s), "undir") for s in (1, 2)])
    assert [r["seed"] for r in rows] == [1, 2] and all(0 <= r["roc_auc"] <= 1 for r in rows)
