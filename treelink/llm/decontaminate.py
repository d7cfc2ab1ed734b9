"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every window of an item (10 consecutive words, or the whole of a shorter item) is a set of shingles that a document has to contain
whole. With containment 1 the necessary prefix is one token, so each window is joined by its rarest shingle, counted over all
documents. Length and position bounds drop candidates whose window would leave the document; the rest is compared word by word.

Defined results: a null or empty text has no words and no hits; an item without words has no window; the words of an item with a
null item_id count as hit, but a null is in no list of item_ids; items that repeat both id and text are one; repeated rows each get their
row; empty documents give no rows and an empty benchmark no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, text_key, words_of


def _shingles(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; none if there are fewer."""
    last = F.size(words) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(k), F.slice(words, i + 1, k)))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, words: distinct windows of each item."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - window, F.lit(0))
    return w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("ws", i + 1, window))).alias("words")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """doc_id, text_key, n_words, hits (positions from 0), item_ids (sorted as strings): one row per row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    pairs = item_windows(benchmark, window).withColumn("win", F.sha2(F.concat_ws(" ", "words"), 256))
    pairs = scratch.save(pairs, "windows")
    windows = pairs.select("win", "words").distinct()
    lengths = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` numbers
    tokens = None
    for k in lengths:
        of_k = windows.filter(F.least(F.size("words"), F.lit(shingle)) == k)
        t = of_k.select("win", "words", F.posexplode(_shingles(F.col("words"), k)).alias("at", "h"))
        tokens = t if tokens is None else tokens.unionByName(t)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tk", text_key("text"))
    if tokens is None:
        return src.select("doc_id", F.col("tk").alias("text_key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("item_ids"))
    tokens = scratch.save(tokens, "tokens")
    known = tokens.select("h").distinct()
    known = broadcast_if_small(known, known.count(), 16)
    worded = src.select("doc_id", "tk", words_of(F.col("text")).alias("ws"))
    hashes = F.concat(*[F.transform(_shingles(F.col("ws"), k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for k in lengths])
    found = worded.select("doc_id", "tk", F.size("ws").alias("n"), F.explode(hashes).alias("s")).select("doc_id", "tk", "n", "s.pos", "s.h").join(known, "h")
    found = scratch.save(found, "found")
    counts = found.groupBy("h").agg(F.count("*").alias("df"))
    rarest = tokens.join(counts, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("at"), F.col("h"))).alias("p"), F.first("words").alias("words"))
    rarest = scratch.save(rarest.filter("p.df > 0").select("win", "words", "p.at", "p.h"), "prefix")
    rare = broadcast_if_small(rarest, rarest.count(), 400)
    start = F.col("pos") - F.col("at")
    cand = found.join(rare, "h").filter((start >= 0) & (start + F.size("words") <= F.col("n")))
    cand = cand.groupBy("doc_id", "tk").agg(F.collect_set(F.struct(start.alias("start"), F.col("words"), F.col("win"))).alias("cand"))  # bounded by the document's own length
    same = (src["doc_id"].eqNullSafe(cand["doc_id"])) & (src["tk"] == cand["tk"])
    near = src.join(cand, same, "left").select(src["doc_id"], src["tk"], words_of(F.col("text")).alias("ws"), "cand")
    ok = F.filter("cand", lambda c: F.slice("ws", c["start"] + 1, F.size(c["words"])) == c["words"])
    near = near.select("doc_id", "tk", F.size("ws").cast("long").alias("n_words"), F.when(F.col("cand").isNotNull(), ok).alias("ok"))
    covered = F.array_distinct(F.flatten(F.transform("ok", lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1))))
    near = near.select("doc_id", "tk", "n_words", F.coalesce(F.array_sort(covered), F.array().cast("array<int>")).alias("hits"), F.array_distinct(F.transform("ok", lambda c: c["win"])).alias("wins"))
    near = scratch.save(near, "verified")
    owners = pairs.select("win", "item_id")
    owners = broadcast_if_small(owners, owners.count(), 150)
    items = near.filter(F.size("wins") > 0).select("doc_id", "tk", F.explode("wins").alias("win")).distinct().join(owners, "win")
    items = items.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    both = near.alias("n").join(items.alias("i"), F.col("n.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("n.tk") == F.col("i.tk")), "left")
    return both.select("n.doc_id", F.col("n.tk").alias("text_key"), "n_words", "hits", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
