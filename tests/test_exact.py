"""Packing one after the other, exact negatives of dense graphs, compressed adjacency and the losses of candidates, against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treelink.operators import dense, gaps, moves, order
from treelink.operators import graph as g
from treelink.operators import training as t
from treelink.operators.order import smallest
from treelink.plans import split_queries
from treelink.scratch import Scratch
from treelink.sources.edges import exact_graph


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def packed_in_turn(costs, cap):
    out, batch, load = [], 0, 0
    for c in costs:
        if load and load + c > cap:
            batch, load = batch + 1, 0
        out.append(batch)
        load += c
        if load > cap:
            batch, load = batch + 1, 0
    return out


@pytest.mark.parametrize("cap, most, lifted", [(20, 9, False), (20, 9, True), (5, 40, False), (1, 3, True), (100000, 9, True), (700, 9, True), (3, 3, False)])
def test_next_fit(spark, monkeypatch, cap, most, lifted):
    monkeypatch.setattr(order, "WALKED", 0 if lifted else 1 << 20)
    rng = np.random.default_rng(cap)
    costs = rng.integers(1, most + 1, 600).tolist()
    costs[100:110] = [cap + 5] * 10
    rows = [(int(i), c) for i, c in enumerate(costs)] + [(1000, 0)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = order.next_fit(spark.createDataFrame([tuple(map(int, r)) for r in rows], "i long, cost long"), ["i"], "cost", cap, "batch").orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.i, r.cost) for r in got] == list(enumerate(costs))
    assert [r.batch for r in got] == packed_in_turn(costs, cap)


def test_next_fit_of_nothing(spark):
    none = spark.createDataFrame([], "i long, cost long")
    assert order.next_fit(none, ["i"], "cost", 5, "batch").count() == 0


def test_last_before(spark):
    rows = [(i, None if i % 7 else i) for i in range(1, 200)]
    got = order.last_before(spark.createDataFrame(rows, "i long, v long").repartition(9), ["i"], "v", "at").collect()
    assert {r.i: r["at"] for r in got} == {i: (i // 7 * 7 or None) for i in range(1, 200)}


def test_ranks_in_gaps(spark, monkeypatch):
    monkeypatch.setattr(gaps, "PIECE", 3)
    taken = {(i, x) for i in range(6) for x in range(20) if (i * x + x) % (i + 2) == 0}
    d = spark.createDataFrame(sorted(taken), "i long, x long")
    sources = spark.createDataFrame([(i, i) for i in range(7)], "i long, low long")
    free = [(i, x) for i in range(7) for x in range(i, 20) if (i, x) not in taken]
    runs = gaps.gaps(d, sources, 20)
    assert pairs(gaps.listed(runs)) == free
    ranks = spark.createDataFrame([(r,) for r in range(0, len(free), 3)], "r long")
    assert pairs(gaps.ranked(runs, ranks)) == free[::3]
    own = [x for x in free if x[0] == 4]
    within = spark.createDataFrame([(4, r) for r in range(len(own))], "i long, r long")
    assert pairs(gaps.ranked(runs, within, within=True)) == own


@pytest.mark.parametrize("free, wanted", [(10, 10), (10, 3), (1 << 50, 7), (1, 1)])
def test_strata(spark, free, wanted):
    got = [r.r for r in spark.range(wanted).select(gaps.strata(F.col("id"), F.lit(free), F.lit(wanted), 1, F.col("id")).alias("r")).orderBy("r").collect()]
    assert len(set(got)) == wanted and got[0] >= 0 and got[-1] < free
    assert all(j * free // wanted <= r < (j + 1) * free // wanted for j, r in enumerate(got))


@pytest.mark.parametrize("strict, loops", [(True, False), (False, False), (False, True)])
def test_negatives_of_a_dense_graph(spark, strict, loops):
    """99 of 100 edges: all free pairs come back if asked for, and any smaller number exactly."""
    n = 40
    e = [(i, j) for i in range(n) for j in range(n) if (min(i, j) * 31 + max(i, j) * 17) % 97 and not (i == j and i % 2)]
    known = set(e) | ({(b, a) for a, b in e} if strict else set())
    free = {(i, j) for i in range(n) for j in range(n) if (i, j) not in known and (loops or i != j) and (not strict or i < j)}
    assert len(free) > 4
    d = edges(spark, e)
    for num in (len(free) + 5, len(free), len(free) - 1, max(1, len(free) // 2)):
        got = pairs(g.negatives(d, num, strict=strict, loops=loops))
        assert len(got) == len(set(got)) == min(num, len(free)) and set(got) <= free


def test_negatives_of_dense_sources(spark):
    n = 30
    e = [(i, j) for i in range(n) for j in range(n) if i != j and (i == 0 or (i + j) % 11)] + [(1, 1)]
    d = edges(spark, e)
    got = pairs(g.negatives_per_node(d, g.nodes(d), 5, seed=2).select("src", "dst"))
    free = {i: {j for j in range(n) if j != i and (i, j) not in e} for i in range(n)}
    for i in range(n):
        mine = [b for a, b in got if a == i]
        assert len(mine) == len(set(mine)) == min(5, len(free[i])) and set(mine) <= free[i]


@pytest.mark.parametrize("hub", [1, 3, 1000])
def test_blocks(spark, hub):
    d = edges(spark, [(0, i) for i in range(1, 30)] + [(i, i * 3 % 50) for i in range(50)] + [(7, 7)])
    blocks = g.adjacency_blocks(d, hub)
    assert pairs(g.from_blocks(blocks)) == pairs(g.adjacency(d))
    starts, at = {}, 0
    for node, _ in pairs(g.adjacency(d)):
        starts[node] = starts.get(node, (at, 0))
        starts[node] = (starts[node][0], starts[node][1] + 1)
        at += 1
    assert {r.node: (r.start, r.n) for r in g.row_pointers(blocks).collect()} == starts
    assert max(r.n for r in blocks.collect()) <= hub


@pytest.mark.parametrize("height, dims, c, portable", [(5, 3, 0.6, True), (12, 4, 1, False), (18, 3, 1, False)])
def test_losses_by_level(height, dims, c, portable):
    """Sums by level equal those of each link, candidate and dimension by itself, and moves are the best of them."""
    cfg = t.TrainConfig(height=height, dims=dims, c=c, portable=portable, weight=1.5)
    rng = np.random.default_rng(height)
    nodes, links = 7, 60
    z, at = rng.integers(0, 1 << height, (nodes, dims)), np.sort(rng.integers(0, nodes, links))
    other = rng.integers(0, 1 << height, (links, dims))
    other[::4] = z[at[::4]]
    other[1::4] = z[at[1::4]] ^ rng.integers(0, 4, (len(at[1::4]), dims))
    y, key = rng.integers(0, 2, links), rng.choice(["out", "in", "neither"], links)
    n12, n21 = np.log(rng.integers(1, 5, links) * 1.0), np.log(rng.integers(1, 5, links) * 1.0)
    cand, rank = moves.candidates_of(np.arange(nodes) * 3 - 4, z, cfg, 1, "z")
    tables, row = moves.loss_tables(key, n12, n21, cfg)
    sums = moves.level_sums(at, z, other, y, tables, row, cand, height)
    every = np.concatenate([cand.reshape(nodes, -1, dims), z[:, None]], axis=1)
    flips = (every[:, :-1] ^ z[:, None]).reshape(nodes, height, cfg.per_level, dims)
    assert all(int(f).bit_length() == lv + 1 for lv in range(height) for f in flips[:, lv].reshape(-1))
    want = np.zeros((nodes, 2, every.shape[1], dims))
    bits = np.vectorize(lambda x: int(x).bit_length())
    for i in range(links):
        now = bits(z[at[i]] ^ other[i])
        for d in range(dims):
            for j, place in enumerate(every[at[i], :, d]):
                dist = (now.sum() - now[d] + int(place ^ other[i, d]).bit_length()) / dims
                p12, p21 = (1 / (1 + ((dist + cfg.eps) / n) ** cfg.gamma / cfg.alpha) if n > 0 else 0.0 for n in (n12[i], n21[i]))
                want[at[i], y[i], j, d] -= np.log(cfg.eps + {"out": p12, "in": p21, "neither": (1 - p12) * (1 - p21)}[key[i]])
    assert np.abs(sums - want).max() < 1e-9
    cnt = np.maximum(1, np.bincount(at[y == 1], minlength=nodes))
    to, loss, pos, neg = moves.settle(z, cand, rank, sums, cnt, cfg.weight)
    total = (cfg.weight * want[:, 1] + want[:, 0]) / cnt[:, None, None]
    assert np.allclose(loss, total.min(axis=1).mean(axis=1)) and np.allclose(loss, cfg.weight * pos + neg)
    for i in range(nodes):
        for d in range(dims):
            best = [j for j in range(every.shape[1]) if total[i, j, d] < total[i, :, d].min() + 5e-10]
            assert to[i, d] == every[i, min(best, key=lambda j: rank[i, j]), d]


def test_batch_costs(spark):
    e = g.directed(edges(spark, [(0, 1), (1, 0), (1, 2), (2, 2), (3, 1)]))
    cfg = t.TrainConfig(epochs=1, convergence=-1.0)
    for variant, want in (("undir", {0: 1, 1: 3, 2: 2, 3: 1}), ("sr", {0: 3, 1: 7, 2: 5, 3: 2}), ("dr", {0: 2, 1: 4, 2: 3, 3: 1})):
        of = g.undirected(e) if variant == "undir" else e
        assert dict(pairs(t.batch_costs(t.links_of(of, variant), cfg, 0))) == want
    masked = t.TrainConfig(epochs=1, convergence=1.0, mask_share=0.0)
    assert dict(pairs(t.batch_costs(t.links_of(e, "sr"), masked, 0))) == {0: 3, 1: 3, 2: 3, 3: 2}


@pytest.mark.parametrize("top,want", [(10, 3), (10_000_000, 4097), (1 << 40, 700), (5000, 0), (5000, 10_000)])
def test_smallest_keys(spark, top, want):
    keys = sorted({random.Random(top).randrange(top) for _ in range(1)} | {random.Random(i).randrange(top) for i in range(5000)})
    d = Scratch(spark, "smallest").save(spark.createDataFrame([(k,) for k in keys], "id long"), "keys")
    assert sorted(r.id for r in smallest(d, "id", want).collect()) == keys[:want]


def plan_of(d):
    return d._jdf.queryExecution().toString()


def test_first_draws_without_one_task(spark):
    """What is drawn first is cut off by a filter; a limit would bring it together in one task."""
    e = spark.createDataFrame([(i, (i * 7 + 1) % 50) for i in range(50)], "src long, dst long")
    for d in (exact_graph(spark, 100, 500, 3, False), exact_graph(spark, 100, 500, 3, True), g.negatives(e, 300, 3)):
        assert "Limit" not in plan_of(d) and "TakeOrdered" not in plan_of(d)
    assert exact_graph(spark, 100, 500, 3, False).distinct().count() == 500
    assert exact_graph(spark, 12, 132, 3, True).distinct().count() == 132


def test_all_free_pairs_without_draws(spark, monkeypatch):
    def none(*_):
        raise AssertionError("drawn")

    monkeypatch.setattr(g, "draw", none)
    e = spark.createDataFrame([(i, (i + k) % 20) for i in range(20) for k in range(1, 12)], "src long, dst long")
    free = {(a, b) for a in range(20) for b in range(20) if a != b and (b - a) % 20 >= 12}
    assert {tuple(r) for r in g.negatives(e, len(free), strict=False).select("src", "dst").collect()} == free


def test_tasks_of_adjacency_grow_in_number(spark, monkeypatch):
    """No range of the order, and no task after it, holds more than a few times TASK_ROWS, however many rows there are."""
    monkeypatch.setattr(order, "TASK_ROWS", 64)
    monkeypatch.setattr(order, "_ranged", lambda *a, _of=order._ranged: ranged.append(_of(*a)) or ranged[-1])
    ranged, e = [], edges(spark, [(i % 40, 1000 + i * 7 % 300) for i in range(3000)])
    got = {(r.node, r.offset): r.n for r in g.adjacency_blocks(e, 16).collect()}
    n = g.adjacency(e).count()
    assert sum(got.values()) == n and max(got.values()) <= 16
    assert ranged[0].groupBy("_part").count().agg(F.max("count")).first()[0] <= 4 * 64


def test_contract_reads_saved_parts(spark):
    """What the check reads several times is not sorted or joined again each time."""
    for d in split_queries.contract_parts(spark, "/root/testdata/sf0.001"):
        assert "Window" not in plan_of(d) and "Join" not in plan_of(d) and "Aggregate" not in plan_of(d)


def test_loss_tables_of_coded_kinds():
    """Powers of distances and of normalisers apart give the losses of the formula, for each kind and also where a normaliser is 0."""
    cfg, kinds = t.TrainConfig(height=5, dims=3, alpha=7.0, gamma=2.5), ["out", "in", "not_out", "not_in", "neither"]
    rng = np.random.default_rng(4)
    key, n12, n21 = rng.integers(0, 5, 200), rng.choice([0.0, 0.7, 3.1, 9.0], 200), rng.choice([0.0, 1.3, 4.2], 200)
    tables, row = moves.coded_tables(kinds, key, n12, n21, cfg)
    p = lambda n: np.where(n > 0, 1 / (1 + ((np.arange(16) / 3 + cfg.eps) / max(n, 1e-300)) ** cfg.gamma / cfg.alpha), 0.0)
    want = [-np.log(cfg.eps + moves.selected(kinds[k], p(a), p(b))) for k, a, b in zip(key, n12, n21, strict=True)]
    assert np.allclose(tables[row], want, rtol=0, atol=1e-12) and len(tables) == len(set(zip(key.tolist(), n12.tolist(), n21.tolist(), strict=True)))


@pytest.mark.parametrize("height, dims, words", [(16, 16, 4), (5, 3, 1), (12, 6, 2), (18, 3, 3)])
def test_places_travel_packed(spark, height, dims, words):
    """Coordinates below 2^16 are sent four to a number and come back as they were, the largest too."""
    z = np.random.default_rng(2).integers(0, 1 << height, (20, dims))
    z[0] = (1 << height) - 1
    rows = spark.createDataFrame([(i, row) for i, row in enumerate(z.tolist())], "i long, z array<long>").select("i", t.packed("z", height, dims).alias("z")).orderBy("i").toArrow()
    assert len(rows["z"][0]) == words and (t.unpacked(rows["z"], height, dims) == z).all()


@pytest.mark.parametrize("n, share, strict, loops, pooled", [(150, 0.9, True, False, True), (150, 0.5, False, True, False), (150, 0.9, False, False, True), (1600, 0.3, False, False, False)])
def test_first_draws_as_bits(spark, monkeypatch, n, share, strict, loops, pooled):
    """Where many of all pairs are wanted, they are those that the first draws hit, without a row for each draw."""

    def none(*_):
        raise AssertionError("a row for each draw")

    monkeypatch.setattr(g, "draw", none)
    inner = [(7 + 10 * i, 7 + 10 * (i * k % n)) for i in range(n) for k in (1, 3, n - 1)]
    d, pool = edges(spark, inner + [(7, 5), (5, 3)] * pooled), edges(spark, inner) if pooled else None
    known = set(inner) | ({(b, a) for a, b in inner} if strict else set())
    cells = n * (n + 1) // 2 if strict else n * n
    num = int(share * cells) - 4 * n
    i, j = (7 + 10 * (moves.consecutive(f"3|{c}|", 0, 4 * n * n // 1000 * 1000) % n) for c in "xy")
    want = {}
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        pair = (min(a, b), max(a, b)) if strict else (a, b)
        if len(want) < num and pair not in known and (a != b or loops):
            want[pair] = True
    assert len(want) == num and pairs(g.negatives(d, num, seed=3, strict=strict, loops=loops, pool=pool)) == sorted(want)


def test_draws_of_consecutive_numbers():
    for low, high in ((0, 0), (0, 12000), (9_990_000, 10_040_000)):
        got = moves.consecutive("3|x|", low, high)
        assert len(got) == high - low and all(got[k] == moves.counter(3, "x", low + k) for k in range(0, high - low, 37))


def test_gaps_of_cells():
    """Cells of parts come back from their gaps, those far apart, equal ones and the first and last of a part too."""
    cells = np.sort(np.r_[0, 0, 5, 259, 260, 515, dense.PART - 1, dense.PART, 3 * dense.PART + 255, 3 * dense.PART + 510, 4 * dense.PART - 1])
    for of in (cells, cells[:0], cells.astype(np.uint32)):
        got = [dense.decoded(pa.scalar(gaps.tobytes(), pa.binary())).astype(np.int64) + part * dense.PART for part, gaps in dense.coded(of)]
        assert np.array_equal(np.concatenate([np.zeros(0, np.int64), *got]), of)


@pytest.mark.parametrize("strict, loops", [(True, False), (False, False), (False, True)])
def test_free_pairs_without_shuffles(spark, tmp_path, strict, loops):
    """All free pairs of several tiles: no pair is shuffled to find its nodes, even where none may be broadcast unasked, and rows are stored in less than half a byte each."""
    n = 700
    name = lambda i: 3 + 1000 * i
    inner = sorted({(i, k * i % n) for i in range(n) for k in (1, 3, 5)} | {(n - 1, 0), (511, 512), (512, 511)})
    d = edges(spark, [(name(i), name(j)) for i, j in inner])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = g.negatives(d, n * n, strict=strict, loops=loops)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        got.write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = spark.read.parquet(str(tmp_path / "pairs")).toArrow()
    free = np.ones((n, n), bool)
    for i, j in inner:
        free[i, j] = False
        free[j, i] &= not strict
    if not loops:
        np.fill_diagonal(free, False)
    want = np.flatnonzero(np.triu(free) if strict else free)
    i, j = ((np.asarray(rows[c]) - 3) // 1000 for c in ("src", "dst"))
    assert np.array_equal(np.sort(i * n + j), want)
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < len(want) / 2


def test_gaps_of_cells_far_apart():
    """Sparse cells take two bytes and little more, not one for each 255 between them."""
    cells = np.sort(np.random.default_rng(5).choice(1 << 24, 4096, replace=False))
    (part, gaps), = dense.coded(cells, 1 << 24, dense._unit(4096, 4096))
    assert not part and gaps.nbytes < 3 * len(cells) and np.array_equal(dense.decoded(pa.scalar(gaps.tobytes(), pa.binary()), np.uint16), cells)


def test_first_draws_in_rounds(spark, monkeypatch):
    """Draws shuffled round by round hit the same pairs of several tiles, and the bits of rounds that are over are dropped."""
    rounds, bucketed, drop = [], Scratch.bucketed, Scratch.drop
    monkeypatch.setattr(dense, "ROUND", 100_000)
    monkeypatch.setattr(Scratch, "bucketed", lambda self, df, name, *a, **k: rounds.append(name) or bucketed(self, df, name, *a, **k))
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: [rounds.append(f"-{x}") for x in names] and drop(self, *names))
    n, seed = 700, 3
    inner = sorted({(7 + 10 * i, 7 + 10 * (i * k % n)) for i in range(n) for k in (1, 3, n - 1)})
    num, known = n * n // 2, set(inner)
    i, j = (7 + 10 * (moves.consecutive(f"{seed}|{c}|", 0, 500_000) % n) for c in "xy")
    want = {}
    for pair in zip(i.tolist(), j.tolist(), strict=True):
        if len(want) < num and pair not in known and pair[0] != pair[1]:
            want[pair] = True
    assert len(want) == num and pairs(g.negatives(edges(spark, inner), num, seed, strict=False)) == sorted(want)
    made = [x for x in rounds if x[0] != "-"]
    assert len(made) >= 3 and sorted(rounds) == sorted(made + [f"-{x}" for x in made])
