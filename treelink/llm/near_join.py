"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts with equal sets of five-word shingles are one class. Classes that share a band of MinHash values form candidate components
(42 bands of 6 values; a pair of similarity 0.8 shares none with probability 3e-6). Inside a component, pairs are compared in blocks:
MinHash values are matched a few at a time, and a pair goes once the posterior probability of reaching the threshold, under a uniform
prior, falls below `tolerance`. Only signatures travel for that. Texts are fetched for classes with a pair left, and the sets of these
pairs are intersected exactly. Blocks return counts and spanning edges, never pairs, so a large group makes no rows beyond its members
times its number of blocks.

Defined results: words are lower-cased A-Z runs of letters and digits; a text of one to four words has one shingle; null, empty and
wordless texts have no links and are groups of their own; repeated rows are copies; an empty table gives no rows; other columns are
ignored, whatever their names. A null doc_id takes part, but never names a group that has another id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, busy_tasks, free_name, text_key

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Members of a block and shingles of its texts, on average; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: MinHash values compared before each look at the posterior.
STEP = 12


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    words = _WORD.findall((text or "").translate(_UPPER))
    if not words:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        codes = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(words)}
        h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
        n = min(k, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(2)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhash(s: np.ndarray, n: int) -> np.ndarray:
    """Least values of n functions of the shingles' upper 32 bits."""
    a, b = _multipliers(n)
    best = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    high = (s >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(high), 256):
            x = high[i : i + 256, None] ^ b
            x *= a
            best = np.minimum(best, x.min(axis=0))
    return best


@lru_cache(8)
def least_matches(values: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of compared values in steps, the matches below which a pair is dropped: P(J >= threshold | m of n) < tolerance."""
    grid = (np.arange(2000) + 0.5) / 2000
    out = []
    for n in range(STEP, values + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def likely_pairs(sig_a, na, sig_b, nb, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that sizes and MinHash values leave; of one block with itself, each pair once. na, nb: sizes of the sets."""
    kept_x, kept_y = [], []
    least = least_matches(sig_a.shape[1], threshold, tolerance)
    for x0 in range(0, len(na), 128):
        rows = slice(x0, x0 + 128)
        lo, hi = np.minimum(na[rows, None], nb), np.maximum(na[rows, None], nb)
        alive = lo >= threshold * hi
        if same:
            alive &= np.arange(len(nb))[None, :] > np.arange(x0, x0 + alive.shape[0])[:, None]
        x, y = np.nonzero(alive)
        x += x0
        matched = np.zeros(len(x), np.int32)
        for i, bound in enumerate(least):
            if not len(x):
                break
            cols = slice(i * STEP, (i + 1) * STEP)
            matched += (sig_a[x, cols] == sig_b[y, cols]).sum(axis=1, dtype=np.int32)
            go = matched >= bound
            x, y, matched = x[go], y[go], matched[go]
        kept_x.append(x)
        kept_y.append(y)
    return np.concatenate(kept_x or [np.empty(0, int)]), np.concatenate(kept_y or [np.empty(0, int)])


def links_between(sig_a, sets_a, sig_b, sets_b, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with exact Jaccard of at least threshold; of one block with itself, each pair once."""
    na, nb = np.array([len(s) for s in sets_a], np.int64), np.array([len(s) for s in sets_b], np.int64)
    x, y = likely_pairs(sig_a, na, sig_b, nb, same, threshold, tolerance)
    if not len(x):
        return x, y
    common = np.zeros(len(x), np.int64)
    if len(x) < 4 * (len(na) + len(nb)):
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            common[i] = len(np.intersect1d(sets_a[p], sets_b[q], assume_unique=True))
    else:  # many pairs: exact intersections as products of 0/1 matrices, a slice of the shingles at a time
        ua, ub = np.unique(x), np.unique(y)
        ra, rb = np.searchsorted(ua, x), np.searchsorted(ub, y)
        fa, fb = np.concatenate([sets_a[i] for i in ua]), np.concatenate([sets_b[i] for i in ub])
        ia, ib = np.repeat(np.arange(len(ua)), na[ua]), np.repeat(np.arange(len(ub)), nb[ub])
        both = np.intersect1d(fa, fb)
        total = np.zeros((len(ua), len(ub)), np.float32)
        for c in range(0, len(both), 4096):
            part = both[c : c + 4096]
            ma, mb = np.zeros((len(ua), len(part)), np.float32), np.zeros((len(ub), len(part)), np.float32)
            for m, f, at in ((ma, fa, ia), (mb, fb, ib)):
                spot = np.searchsorted(part, f)
                hit = part[np.minimum(spot, len(part) - 1)] == f
                m[at[hit], spot[hit]] = 1
            total += ma @ mb.T
        common = total[ra, rb].astype(np.int64)
    ok = common >= threshold * (na[x] + nb[y] - common) - 1e-9
    return x[ok], y[ok]


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while len(x):
        m = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], m)
        np.minimum.at(new, root[y], m)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def components(scratch: Scratch, member: DataFrame, name: str) -> DataFrame:
    """From (v, hub) to (v, comp): vertices that share hubs, directly or through others, get the smallest v among them.

    Each round is two aggregations and a join on narrow rows; rounds stop when no label moves.
    """
    scratch.save(member.select("v", "hub", F.col("v").alias("comp")), f"{name}-0")
    n = 0
    while True:
        state = member.sparkSession.read.parquet(scratch.path(f"{name}-{n}"))
        by_hub = state.groupBy("hub").agg(F.min("comp").alias("low"))
        by_v = state.join(by_hub, "hub").groupBy("v").agg(F.min("low").alias("low"))
        short = by_v.select(F.col("v").alias("c"), F.col("low").alias("lower"))  # the label's own label
        by_v = by_v.join(short, by_v["low"] == short["c"], "left").select("v", F.least("low", F.coalesce("lower", "low")).alias("low"))
        new = scratch.save(state.join(by_v, "v").select("v", "hub", F.col("low").alias("comp"), (F.col("low") < F.col("comp")).alias("moved")), f"{name}-{n + 1}")
        scratch.drop(f"{name}-{n}")
        n += 1
        if not new.filter("moved").limit(1).count():
            return new.groupBy("v").agg(F.min("comp").alias("comp"))


def jaccard_groups(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 42, rows: int = 6, tolerance: float = 1e-9) -> DataFrame:
    """doc_id, tk (a hash of the text), class_id (smallest doc_id of the linked group), n_links (other classes within the threshold), n_copies (documents with the same shingles), keeper (one row of each group is it)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    values = bands * rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, n, sigs = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), shingle)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(minhash(s, values).tobytes() if len(s) else None)
                n.append(len(s))
            yield pa.record_batch({"doc_id": batch.column(0), "tk": batch.column(2), "v": pa.array(digest, pa.binary()), "n": pa.array(n, pa.int64()), "sig": pa.array(sigs, pa.binary())})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key("text").alias("tk"))
    marked = scratch.save(src.mapInArrow(read, "doc_id long, tk long, v binary, n long, sig binary"), "marked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    classes = marked.filter("v is not null").groupBy("v").agg(F.min(order).alias("rep"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.save(classes, "classes")
    marked = marked.select("doc_id", "tk", "v")

    width = 4 * rows
    band = lambda b: F.xxhash64(F.substring(F.col("sig"), b * width + 1, F.lit(width)), b)
    spread = classes.select("v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("hub"))
    shared = spread.groupBy("hub").agg(F.count("*").alias("c")).filter("c > 1").select("hub")
    member = scratch.save(spread.join(shared, "hub"), "member")
    comp = scratch.save(components(scratch, member, "candidate"), "comp")
    scratch.drop("member")

    # Components in blocks: a member goes to every pair of blocks that its own block is in.
    comp = comp.join(classes.select("v", "n", "sig"), "v")
    sizes = comp.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = comp.join(sizes, "comp").withColumn("mine", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("v", "comp", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "n", "sig")

    def sides(key: tuple, group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = group["mine"].to_numpy()
        return np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), values), np.nonzero(mine == key[1])[0], np.nonzero(mine == key[2])[0]

    def prune(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """The members that have a likely pair in these blocks."""
        sig, left, right = sides(key, group)
        n = group["n"].to_numpy()
        x, y = likely_pairs(sig[left], n[left], sig[right], n[right], key[1] == key[2], threshold, tolerance)
        return group.iloc[np.union1d(left[x], right[y]).astype(int)]

    tasks = busy_tasks(docs.sparkSession)
    likely = scratch.save(placed.repartition(tasks, "comp", "a", "b").groupBy("comp", "a", "b").applyInPandas(prune, placed.schema), "likely")
    wanted = scratch.save(likely.select("v").distinct().join(classes.select("v", "rep"), "v").select("v", F.col("rep.doc_id").alias("r"), F.col("rep.tk").alias("rt")), "wanted")
    few = broadcast_if_small(wanted, wanted.count(), 40)
    texts = scratch.save(src.join(few, src["doc_id"].eqNullSafe(few["r"]) & (src["tk"] == few["rt"])).select("v", "text").dropDuplicates(["v"]), "texts")
    loaded = likely.join(texts, "v").repartition(tasks, "comp", "a", "b")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v", ignore_index=True)
        sets = [shingle_set(t, shingle) for t in group["text"]]
        sig, left, right = sides(key, group)
        x, y = links_between(sig[left], [sets[i] for i in left], sig[right], [sets[i] for i in right], key[1] == key[2], threshold, tolerance)
        x, y = left[x], right[y]
        links = np.bincount(x, minlength=len(group)) + np.bincount(y, minlength=len(group))
        root = _roots(len(group), x, y)
        some = links > 0
        v = group["v"].to_numpy()
        return pd.DataFrame({"v": v[some], "hub": v[root[some]], "links": links[some]})

    linked = scratch.save(loaded.groupBy("comp", "a", "b").applyInPandas(compare, "v binary, hub binary, links long"), "linked")
    counts = linked.groupBy("v").agg(F.sum("links").alias("n_links"))
    group = scratch.save(components(scratch, linked.select("v", "hub").unionByName(linked.select(F.col("hub").alias("v"), "hub")).distinct(), "group"), "group")
    scratch.drop("likely", "wanted", "texts", "comp")
    full = classes.drop("sig", "n").join(group, "v", "left").join(counts, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    best = full.groupBy("comp").agg(F.min("rep").alias("best"))
    full = full.join(best, "comp").select("v", "best", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "rep")
    out = marked.join(full, "v", "left")
    alone = F.col("v").isNull()
    first = F.when(alone, True).otherwise(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tk") == F.col("best.tk")))
    return out.select("doc_id", "tk", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), first.alias("keeper"))


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are near copies of their group's first document.

    Of rows that repeat that one's doc_id and text, the one stays whose columns are least as JSON.
    """
    gone = jaccard_groups(docs, **options).filter("not keeper").select(F.col("doc_id").alias("_gone_id"), F.col("tk").alias("_gone_tk")).distinct()
    d = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (text_key(docs["text"]) == gone["_gone_tk"]), "left_anti")
    tk, nth = free_name(docs, "tk"), free_name(docs, "nth")
    worded = F.length(F.regexp_replace("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "")) > 0
    again = docs.filter(worded).groupBy(F.col("doc_id").cast("long").alias("_id"), text_key("text").alias("_tk")).agg(F.count("*").alias("c")).filter("c > 1").select("_id", "_tk")
    again = Scratch(docs.sparkSession, "jaccard-again").save(again, "again")
    if not again.limit(1).count():
        return d
    same = d["doc_id"].cast("long").eqNullSafe(again["_id"]) & (text_key(d["text"]) == again["_tk"])
    order = Window.partitionBy("doc_id", tk).orderBy(F.to_json(F.struct(*[F.col(c) for c in docs.columns])))
    first = d.join(again, same, "left_semi").withColumn(tk, text_key("text")).withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return d.join(again, same, "left_anti").unionByName(first.select(*docs.columns))
