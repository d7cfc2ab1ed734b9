"""Exact search, hard negatives and conversation repair against brute force, with odd tables, ties and copies."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelink.llm import hard_negatives, queries
from treelink.llm.conversations import Solver, damage, repair, with_lost
from treelink.llm.hard_negatives import mine
from treelink.llm.int_vectors import products
from treelink.llm.knn_join import needed, search_exactly

SF = "/root/testdata/sf0.01"


def usable(rows, scale, labelled=False):
    """(vec_id, floor(scale x), label) of rows that take part."""
    out = []
    for i, e, *label in rows:
        if i is None or not e or any(x is None or not np.isfinite(x) for x in e) or (labelled and label[0] is None):
            continue
        out.append((i, np.floor(np.array(e, np.float64) * scale).astype(np.int64), *label))
    most = max({len(v[1]) for v in out}, key=lambda n: sum(len(v[1]) == n for v in out)) if out else 0
    return [v for v in out if len(v[1]) == most]


def plain_search(rows, every=20, k=20, scale=64):
    v = usable(rows, scale)
    x = np.array([a[1] for a in v])
    ids, out = np.array([a[0] for a in v]), []
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out += [(int(ids[q]), n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(order)]
    return sorted(out)


def plain_negatives(rows, every=50):
    v = usable(rows, 256, True)
    ids, x = np.array([a[0] for a in v]), np.array([a[1] for a in v])
    lab = np.array([(a[2] + 1) % 10 if a[0] % 7 == 0 else a[2] for a in v])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        for p in [i for i in order if i != a and lab[i] == lab[a]][:5]:
            near = [i for i in order if lab[i] != lab[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            out += [(int(ids[a]), int(ids[p]), n + 1, int(ids[i]), int(s[p]), int(s[i])) for n, i in enumerate(near)]
    return sorted(out)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


SEARCHED = ("query_id", "rank", "vec_id", "score")
MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_queries_on_whole_tables(spark):
    e = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(queries.op11_exact_topk(spark, SF), *SEARCHED) == plain_search([r[:2] for r in e])
    assert rows_of(queries.op13_hard_negatives(spark, SF), *MINED) == plain_negatives(e)


def clustered(n=1500, dims=8, seed=1):
    """Tight clusters, a third of the rows copies of one vector, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, dims))[rng.integers(30, size=n)] * 3 + rng.normal(size=(n, dims)) * 0.05
    x[rng.choice(n, n // 3, replace=False)] = x[5]
    rows = [(i, v.tolist(), int(rng.integers(10))) for i, v in enumerate(x)]
    odd = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] * dims, [1.0], [0.0] * dims, [0.0] * dims]
    return rows + [(2000 + 100 * i, e, 3) for i, e in enumerate(odd)] + [(3000, x[7].tolist(), None), (3100, x[5].tolist(), 4)]


def frame(spark, rows):
    """With other columns, of names that the operators use themselves."""
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    return d.withColumn("e", F.lit(1)).withColumn("uid", F.lit("x")).withColumn("Code", F.lit(2)).withColumn("q", F.lit(3)).withColumn("bucket", F.lit(4))


@pytest.mark.parametrize("sizes", [{}, {"pivots": 7, "groups": 3, "block": 8, "slot_rows": 100}, {"pivots": 1, "groups": 1}])
def test_exact_search(spark, sizes):
    rows = clustered()
    got = search_exactly(frame(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, **sizes)
    assert rows_of(got, *SEARCHED) == plain_search([r[:2] for r in rows])


def test_rows_are_sent_where_they_are_needed():
    """Tight clusters: a row goes to few cells, and to all whose queries have it among their best."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 16))[rng.integers(12, size=900)] * 10 + rng.normal(size=(900, 16)) * 0.02
    centre, queries, k = x[:40], x[::20], 5
    cell = ((queries[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
    radius = np.array([np.linalg.norm(queries[cell == i] - c, axis=1).max(initial=0) for i, c in enumerate(centre)])
    dots, length = x @ centre.T, np.linalg.norm(x, axis=1)
    bound = np.sort(dots - radius * length[:, None], axis=0)[-k]
    sent = needed(dots, length, radius, bound)[:, np.unique(cell)]
    at = dict(zip(np.unique(cell), range(99), strict=False))
    for q, c in zip(queries, cell, strict=True):
        assert sent[np.argsort(-(x @ q))[:k], at[c]].all()
    assert sent.mean() < 0.2


def test_search_of_little(spark):
    few = [(0, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (20, [0.5, -1.0], 2), (7, [3.0, 0.0], 2)]
    assert rows_of(search_exactly(frame(spark, few), F.col("vec_id") % 20 == 0), *SEARCHED) == plain_search([r[:2] for r in few])
    for none in ([], [(0, None, 1)], [(1, [1.0], 1)]):
        assert search_exactly(frame(spark, none), F.col("vec_id") % 20 == 0).count() == 0
        assert mine(frame(spark, none), F.col("label"), F.col("vec_id") % 50 == 0).count() == 0


def test_large_numbers(spark):
    a = np.array([[2**40, 3], [5, -(2**31)]])
    assert (products(a, a.T.copy()) == a @ a.T.T).all()
    rows = [(20 * i, [1e6 * i, -1e5, float(i)], i % 2) for i in range(12)] + [(1, [1e300, 0.0, 0.0], 0)]
    got = rows_of(search_exactly(frame(spark, rows[:12]), F.col("vec_id") % 20 == 0), *SEARCHED)
    assert got == plain_search([r[:2] for r in rows[:12]])
    assert search_exactly(frame(spark, rows), F.col("vec_id") % 20 == 0).count() == 12 * 12


@pytest.mark.parametrize("sizes", [{}, {"anchor_block": 4, "row_block": 60, "chunks": 3}, {"chunks": 1}])
def test_hard_negatives(spark, sizes):
    rows = clustered(700, seed=2)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mine(frame(spark, rows).repartition(4), label, F.col("vec_id") % 50 == 0, **sizes)
    want = plain_negatives(rows)
    assert rows_of(got, *MINED) == want and len(want) > 20


def test_hard_negatives_of_mixed_buckets(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKETS", 3)
    rows = clustered(400, seed=5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert rows_of(mine(frame(spark, rows), label, F.col("vec_id") % 50 == 0, row_block=50), *MINED) == plain_negatives(rows)


def edits_of(signature, most=9):
    """All audits of up to `most` letters, cheapest and least first, that leave pairs of user and assistant: by trying all of them."""
    best = None
    todo = [(0, 0, "", "")]
    while todo:
        i, cost, audit, roles = todo.pop()
        if i == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if len(audit) == most or (best and cost > best[0]):
            continue
        todo += [(i, cost + 3, audit + "I", roles + r) for r in "ua"]
        if i < len(signature):
            todo.append((i + 1, cost + 4, audit + "D", roles))
            if signature[i] != "d":
                more = 3 if signature[i].isupper() else 0
                todo.append((i + 1, cost + more, audit + "K", roles + signature[i].lower()))
                todo += [(i + 1, cost + 3 + more, audit + "R", roles + r) for r in "ua"]
    return best


def test_cheapest_edits():
    for n in range(4):
        for s in map("".join, itertools.product("suaxSUAd", repeat=n)):
            cost, audit, _ = Solver(s).solve()
            assert (cost, audit) == edits_of(s, 2 * n + 1), s
    long = Solver("ua" * 3000 + "sUd" * 500).solve()
    assert long[0] > 0 and len(long[1]) >= 7500 - 1


def plain_repair(rows):
    """The contract's columns by conversation, row by row."""
    by, sp = defaultdict(list), lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        k, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, faults, sig, seen = [r[0] for r in found if r[0] is not None], defaultdict(int), "", set()
        for _, role, text in found:
            kept = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            sig += "d" if fault in ("blank", "duplicate") else c.upper() if fault else c
        cost, audit, replay = Solver(sig).solve()
        lines = [f"{name or found[i][1]}:{'' if i < 0 else found[i][2]}" for i, name in replay]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


REPAIRED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversations(spark, "/root/testdata/sf0.1")
    assert [c for c in got.columns] == ["conv_id", *REPAIRED]
    assert {r.conv_id: tuple(r[c] for c in REPAIRED) for r in got.collect()} == plain_repair(rows)


@pytest.mark.parametrize("limit", [None, 0])
def test_odd_conversations(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr("treelink.scratch.BROADCAST_BYTES", limit)
        monkeypatch.setattr("treelink.llm.conversations.broadcast_if_small", lambda df, *_: df)
    texts = ["Fine.", "cut off", "", None, " \t\n", "Fine.", "y" * 2_000_000 + ".", "ends.\n \x0b", "non-break ", "é!", "a.\n\n"]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "summary"]
    rows = [(c, None if (c + t) % 9 == 0 else t // 2, roles[(c * 3 + t * 5) % len(roles)], texts[(c + t * t) % len(texts)]) for c in range(60) for t in range(c % 9)]
    rows += [(None, t, "user" if t % 2 else "assistant", "Hi.") for t in range(6)] + [(900, None, None, None), (901, 4, "user", "Hello?"), (901, 4, "user", "Hello?")]
    rows += [(500, t, roles[t % 2], f"Turn {t}.") for t in range(3000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("sig", F.lit(1)).withColumn("Part", F.lit(2)).withColumn("rows", F.lit(2))
    done = with_lost(repair(damage(d)), d).withColumn("repaired_sha256", F.sha2("repaired", 256))
    assert {r.conv_id: tuple(r[c] for c in REPAIRED) for r in done.collect()} == plain_repair(rows)
    assert with_lost(repair(damage(d.limit(0))), d.limit(0)).count() == 0
