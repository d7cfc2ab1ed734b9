"""Line dedup by a suffix array over the line ids of all documents. DataFrame functions only.

A line's id is two 64-bit hashes of it without the blanks at its ends. Prefix doubling ranks the suffixes of all documents by their
first 1, 2, 4, ... lines: a round sorts pairs of ranks by ranges and counts, so that a rank is the place in the suffix array where the
suffixes that agree so far begin; only suffixes whose class can still be split take part in the next round, and rounds end when none
is. Suffixes that agree in `min_lines` lines lie side by side and form a longest-common-prefix interval; their rank after that round
names it. In each interval the first suffix in the order of (doc_id, line) is the copy that stays. A later one begins a maximal run
unless the line before it goes on from the line before that copy; its common prefix with the copy is found by comparing their ranks of
1, 2, 4, ... lines from the widest down, and that many lines are deleted: the whole repeated run in one piece. A copy that overlaps the
first one in the same document is no later copy: in `a a a b` nothing is deleted, and of `a a a a` the last two lines are.
A single line of at least `min_words` words (separated by spaces and tabs) is a run too, whatever its neighbours are, so a passage
on one line and a document of one line are found as well.

Defined results: lines are compared without spaces at their ends, blank lines are no part of runs and stay between kept lines; a
null text is kept as null and an empty one as empty; rows that repeat both doc_id and text are one document and lose the same lines;
a document whose text another one has goes whole if it is later (a null doc_id is last) and holds a run; an empty table gives no rows;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered, prefix_sums
from .common import Scratch, broadcast_if_small, free_name, temporary, text_key


def document_lines(docs: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """tk, dn, lines: for each distinct text its number in the order of its first document, and its lines (a, b, i: their number with blank ones, w: whether one is a run by itself)."""
    full = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("i"))), lambda x: x["t"] != "")
    # Words are counted only where a line has room for so many.
    long = lambda t: (F.length(t) >= 2 * min_words - 1) & (F.regexp_count(t, F.lit(r"[^ \t]+")) >= min_words)
    name = lambda x: F.struct(F.xxhash64(x["t"]).alias("a"), F.xxhash64(F.lit(11), x["t"]).alias("b"), x["i"].alias("i"), long(x["t"]).alias("w"))
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("id"), text_key("text").alias("tk"), F.transform(full, name).alias("lines"))
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    texts = scratch.save(rows.groupBy("tk").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first("lines").alias("lines")), "texts")
    return scratch.save(numbered(texts, ["first", "tk"], "dn"), "documents")


def suffix_ranks(lines: DataFrame, scratch: Scratch, depth: int, widths: dict[int, DataFrame] | None = None) -> DataFrame:
    """dn, k, rank, top for lines (dn, k, a, b): where in the suffix array the suffixes begin that equal this one to its end, and those that agree with it in `depth` lines (a power of two); top is null where fewer lines follow.

    widths gets, by number of lines (1, 2, 4, ...), dn, k and rank of the suffixes that agree in so many with another one.
    """
    classes = lines.groupBy("a", "b").agg(F.count("*").alias("c"))
    with temporary():
        state = lines.join(prefix_sums(classes, ["a", "b"], {"rank": F.col("c")}), ["a", "b"]).select("dn", "k", "rank", (F.col("c") > 1).alias("live"))
        state = scratch.save(state.withColumn("top", F.lit(None).cast("bigint")), "ranks-1")
    width, widths = 1, {} if widths is None else widths
    widths[1] = scratch.save(state.filter("live").select("dn", "k", "rank"), "shared-1")
    while True:
        ahead = Window.partitionBy("dn").orderBy("k")
        then = F.coalesce(F.lead("rank", width).over(ahead), F.lit(-1))  # a suffix that ends comes first
        pairs = scratch.save(state.withColumn("then", then).withColumn("full", F.lead("k", 2 * width - 1).over(ahead).isNotNull()), f"pairs-{width}")
        live = pairs.filter("live").groupBy("rank", "then").agg(F.count("*").alias("c"))
        with temporary():
            live = scratch.save(prefix_sums(live, ["rank", "then"], {"before": F.col("c")}), f"order-{width}")
        starts = live.groupBy("rank").agg(F.min("before").alias("start"), F.count("*").alias("parts"))
        new = live.join(starts, "rank").select("rank", "then", (F.col("rank") + F.col("before") - F.col("start")).alias("new"), ((F.col("c") > 1) & (F.col("then") >= 0)).alias("again"))
        moved = pairs.filter("live").join(new, ["rank", "then"]).select("dn", "k", F.col("new").alias("rank"), F.col("again").alias("live"), "top", "full")
        state = moved.unionByName(pairs.filter("not live").select("dn", "k", "rank", "live", "top", "full"))
        if 2 * width == depth:  # a suffix of fewer lines is in no interval of this depth
            state = state.withColumn("top", F.when(F.col("full"), F.col("rank")))
        state = scratch.save(state, f"ranks-{2 * width}")
        widths[2 * width] = scratch.save(state.filter("live and full").select("dn", "k", "rank"), f"shared-{2 * width}")
        state = state.drop("full")
        split = starts.filter("parts > 1").limit(1).count()
        scratch.drop(f"ranks-{width}", f"pairs-{width}", f"order-{width}")
        width *= 2
        if width >= depth and not split:
            return state.drop("live")


def maximal_runs(later: DataFrame, widths: dict[int, DataFrame]) -> DataFrame:
    """dn, k, n: runs of n lines that later copies (dn, k, f: dn and k of the first copy) begin, as long as they agree with the first copy."""
    before = F.lag(F.struct("k", "f")).over(Window.partitionBy("dn").orderBy("k"))
    goes_on = (before["k"] == F.col("k") - 1) & (before["f"]["dn"] == F.col("f")["dn"]) & (before["f"]["k"] == F.col("f")["k"] - 1)
    runs = later.withColumn("inside", F.coalesce(goes_on, F.lit(False))).filter("not inside").select("dn", "k", F.col("f.dn").alias("fd"), F.col("f.k").alias("fk"), F.lit(0).alias("n"))
    for width in sorted(widths, reverse=True):
        own = widths[width].select(F.col("dn").alias("od"), F.col("k").alias("ok"), F.col("rank").alias("own"))
        first = widths[width].select(F.col("dn").alias("pd"), F.col("k").alias("pk"), F.col("rank").alias("that"))
        runs = runs.join(own, (F.col("dn") == F.col("od")) & (F.col("k") + F.col("n") == F.col("ok")), "left")
        runs = runs.join(first, (F.col("fd") == F.col("pd")) & (F.col("fk") + F.col("n") == F.col("pk")), "left")
        runs = runs.select("dn", "k", "fd", "fk", (F.col("n") + F.when(F.col("own") == F.col("that"), width).otherwise(0)).alias("n"))
    return runs.select("dn", "k", "n")


def deleted_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """tk, first, gone, whole: for each distinct text with a run that is a later copy, or that several documents may have, its first doc_id, the numbers of its lines that go in that document, and those that go in the others."""
    if min_lines < 2 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two from 2 on")
    result = Scratch(docs.sparkSession, "line-dedup")
    with temporary():
        return result.save(_deleted(docs, min_lines, min_words), "deleted")


def _deleted(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "line-suffixes")
    texts = document_lines(docs, scratch, min_words)
    lines = texts.select("dn", F.posexplode("lines").alias("k", "x")).select("dn", "k", "x.a", "x.b", "x.w")
    lines = scratch.save(lines, "lines")
    widths: dict[int, DataFrame] = {}
    ranks = suffix_ranks(lines.select("dn", "k", "a", "b"), scratch, min_lines, widths)
    place = F.struct("dn", "k")
    found = ranks.filter("top is not null").select("dn", "k", F.col("top").alias("run"))
    first = found.groupBy("run").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f < l").select("run", "f")
    later = found.join(first, "run").filter((F.col("dn") != F.col("f.dn")) | (F.col("k") >= F.col("f.k") + min_lines))
    later = scratch.save(maximal_runs(scratch.save(later.select("dn", "k", "f"), "later"), widths), "runs")
    later = later.select("dn", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("n") - 1)).alias("k"))
    single = lines.filter("w")
    alone = single.groupBy("a", "b").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f < l").select("a", "b", "f")
    later = later.unionByName(single.join(alone, ["a", "b"]).filter(place > F.col("f")).select("dn", "k"))
    gone = scratch.save(later.groupBy("dn").agg(F.collect_set("k").alias("ks")), "gone")  # bounded by the document's own lines
    at = lambda keep: F.transform(F.filter("lines", keep), lambda x: x["i"])
    return texts.join(gone, "dn", "left").filter("ks is not null or copies > 1").select("tk", F.col("first.id").alias("first"), F.when(F.col("ks").isNotNull(), at(lambda x, i: F.array_contains("ks", i))).alias("gone"), F.when(F.col("copies") > 1, at(lambda x: x["w"] | (F.size("lines") >= min_lines))).alias("whole"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the remaining text and the numbers of non-blank lines before and of those removed, named by counts; columns of these names are replaced."""
    gone = deleted_lines(docs, min_lines, min_words)
    kept = [c for c in docs.columns if c not in ("text", *counts)]
    key, parts, drop, id_ = (free_name(docs, x) for x in ("key", "parts", "drop", "id"))
    d = docs.select(*kept, "text", text_key("text").alias(key), F.col("doc_id").cast("long").alias(id_))
    g = gone.select(F.col("tk").alias(key), F.col("first").alias(free_name(docs, "first")), F.col("gone").alias(free_name(docs, "gone")), F.col("whole").alias(free_name(docs, "whole")))
    first, some, whole = g.columns[1:]
    width = lambda c: F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 4)
    size = g.agg(F.coalesce(F.count("*") * 64 + F.coalesce(width(some), F.lit(0)) + F.coalesce(width(whole), F.lit(0)), F.lit(0))).first()[0]
    # Texts stay where they are if what is to be deleted is few bytes.
    j = d.join(broadcast_if_small(g, size, 1), key, "left")
    # Arrays that lambdas index are columns with several uses, which the optimizer doesn't inline: a split runs once a row, not once a line.
    j = j.withColumn(parts, F.split(F.col("text"), "\n")).withColumn(drop, F.when(F.col(id_).eqNullSafe(F.col(first)), F.col(some)).otherwise(F.col(whole)))
    n_lines = F.aggregate(F.col(parts), F.lit(0), lambda s, x: s + (F.trim(x) != "").cast("int"))
    stay: Column = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
    text = F.when(F.coalesce(F.size(drop), F.lit(0)) <= 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col(parts)[i]), "\n"))
    return j.select(*kept, text.alias("text"), F.coalesce(n_lines, F.lit(0)).cast("long").alias(counts[0]), F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)).cast("long").alias(counts[1]))
