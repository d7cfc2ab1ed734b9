"""Removal of repeated byte strings over the whole corpus, by suffix order within buckets of suffixes that can agree.

Strings of `length` bytes are matched exactly. A suffix matters up to its first `length` bytes only, its window. Every window is dealt
by its minimiser (the least hash of its inner 48-byte strings), so equal windows meet. Minimisers that occur at one place only are
counted away first. The stretch of windows that share a minimiser is a context; equal contexts are counted before anything is sent
on. Distinct contexts of one minimiser meet in one task, which puts all their suffixes in order by prefix doubling over their bytes
and reads longest previous factors off it: suffixes that agree in `length` bytes are ordered by position, so the previous smaller
position of a suffix is its neighbour, and one with no neighbour so near has no factor of `length` bytes. If a minimiser has many
contexts, a second order of minimisers cuts them into smaller ones, and what is still crowded then is dealt out window by window
under two 64-bit hashes. Longest previous factors over one suffix array of all bytes are not built: see the README.

Defined results: a null text has no bytes; equal texts are read once and count as often as they occur; texts shorter than `length`
lose nothing; matches never cross documents; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, text_key

#: Bytes of the strings whose hashes are minimised.
INNER = 48
#: Contexts of one minimiser that a task matches in memory. Those of a minimiser with more are cut again by a second one, and where
#: that leaves too many still, each window is dealt out by its name.
CROWD = 1000
#: Bytes of texts or contexts that are worked on at a time.
CHUNK = 1 << 20
#: Low bits of a hash that make room for a position within a chunk and one more text's part.
PLACE_BITS = 22


@lru_cache(8)
def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1, 1 << 62)) * 8 + 5
    base %= 1 << 64
    return rng.integers(0, 1 << 64, 256, dtype=np.uint64), base, pow(base, -1, 1 << 64)


@lru_cache(16)
def _powers(x: int, bits: int) -> np.ndarray:
    """x^i mod 2^64 for i < 2^bits."""
    out = np.full(1 << bits, np.uint64(x))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _sums(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums whose differences, times a power, are polynomial hashes of ranges; and these powers."""
    table, base, inverse = _tables(seed)
    bits = max(12, len(data).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * _powers(inverse, bits)[: len(data)], dtype=np.uint64, out=total[1:])
    return total, _powers(base, bits)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ h >> np.uint64(29)


def rolling(data: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of width bytes."""
    if len(data) < width:
        return np.empty(0, np.uint64)
    total, powers = _sums(data, seed)
    with np.errstate(over="ignore"):
        return _mixed((total[width:] - total[:-width]) * powers[: len(data) - width + 1])


def range_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each range [lo, hi) of data."""
    total, powers = _sums(data, seed)
    with np.errstate(over="ignore"):
        return _mixed((total[hi] - total[lo]) * powers[lo] + (hi - lo).astype(np.uint64))


def minimisers(pieces: list[bytes], length: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces as one array; hash, piece, first and last window start in that array of each run of windows with one minimiser."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    inner = min(INNER, length)
    h = rolling(data, inner, seed)
    span, none = length - inner + 1, np.empty(0, np.int64)
    n = len(h) - span + 1
    if n <= 0:
        return data, np.empty(0, np.uint64), none, none, none
    # The upper bits order the strings and the lower ones are their places, so that a minimum is the leftmost least hash.
    least, have = h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(h), dtype=np.uint64), 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(pieces)), sizes)[:n]
    starts = np.flatnonzero(np.arange(n) + length <= ends[own])  # windows don't cross the end of a piece
    if not len(starts):
        return data, np.empty(0, np.uint64), none, none, none
    at = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return data, h[at[cut]], own[starts[cut]], starts[cut], starts[np.concatenate([cut[1:], [len(at)]]) - 1]


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position among all by its `length` bytes, in byte order, by prefix doubling; equal strings share a rank."""
    width = min(8, length)
    key = np.zeros(max(0, len(data) - width + 1), np.uint64)
    for i in range(width):
        key = key << np.uint64(8) | data[i : i + len(key)]
    ranks = np.unique(key, return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        if len(ranks) <= step:
            return np.empty(0, np.int64)
        ranks = np.unique(ranks[:-step].astype(np.uint64) << np.uint64(32) | ranks[step:].astype(np.uint64), return_inverse=True)[1]
        width += step
    return ranks


def longest_previous(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending starts: whether its longest previous factor, and whether a later one, has `length` bytes."""
    ranks = prefix_ranks(data, length)[starts]
    order = np.argsort(ranks, kind="stable")  # by string, then by position
    near = ranks[order[1:]] == ranks[order[:-1]]
    before, after = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    before[order[1:][near]] = True
    after[order[:-1][near]] = True
    return before, after


def _ranges(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged [from, to) of the windows that begin at starts (sorted)."""
    cut = np.nonzero(np.diff(starts) > length)[0]
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def _windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces as one array; start in it, piece and place in the piece of each window."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(pieces)), sizes)[: max(0, len(data) - length + 1)]
    at = np.flatnonzero(np.arange(len(own)) + length <= ends[own])  # not across the end of a piece
    own = own[at]
    return data, at, own, (at - (ends - sizes)[own]).astype(np.int32)


def window_names(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit names, the piece and the place in it of each window of the pieces."""
    data, at, own, d = _windows(pieces, length)
    return rolling(data, length, 2)[at], rolling(data, length, 3)[at], own, d


def _matched(rows: list[tuple], length: int) -> pa.RecordBatch:
    """a, b, lo and ds: the windows that occur again in rows (h, n, lo, a, b, piece), of contexts that occur once."""
    data, at, own, d = _windows([r[-1] for r in rows], length)
    before, after = longest_previous(data, at, length)
    hit = (before | after) & np.array([r[1] == 1 for r in rows])[own]
    own, d = own[hit], d[hit]
    which, first = np.unique(own, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(d)), pa.int32()), pa.array(d, pa.int32()))
    a, b, lo = (pa.array([rows[i][c] for i in which], pa.int64()) for c in (3, 4, 2))
    return pa.record_batch({"a": a, "b": b, "lo": lo, "ds": lists})


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, text, spans: array of (lo, hi) byte ranges of each row that lie in strings that occur more than once."""
    scratch = Scratch(docs.sparkSession, "substrings")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.select("doc_id", "text", text_key("text").alias("a"), F.xxhash64(F.lit(13), F.col("text")).alias("b"))
    per = src.filter(F.octet_length("text") >= length).groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    per = scratch.save(per, "texts")

    def one_of_each(of: DataFrame, *columns: str) -> DataFrame:
        """The text of one row of each of the texts; rows that agree in doc_id too give it several times, which does no harm as such texts go whole."""
        return src.join(of, (src["a"] == of["a"]) & (src["b"] == of["b"]) & src["doc_id"].eqNullSafe(of["rep"])).select(src["a"], src["b"], *columns, "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # a, b, copies, offset in the text, bytes

        def flush() -> pa.RecordBatch:
            data, h, own, lo, hi = minimisers([r[4] for r in held], length)
            begin = np.concatenate([[0], np.cumsum([len(r[4]) for r in held])])[own]
            a, b, copies, shift = (np.array([r[c] for r in held], np.int64)[own] for c in range(4))
            names = [range_hashes(data, lo, hi + length, seed).view(np.int64) for seed in (5, 6)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, copies, h.view(np.int64), *names, lo - begin + shift, hi - begin + shift)], names=["a", "b", "copies", "h", "x", "y", "lo", "hi"])

        size = 0
        for batch in batches:
            for a, b, copies, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for s in range(0, len(data) - length + 1, CHUNK):  # a long text by parts whose windows adjoin
                    part = data[s : s + CHUNK + length - 1]
                    if held and size + len(part) > CHUNK:
                        yield flush()
                        size = 0
                    held.append((a, b, copies, s, part))
                    size += len(part)
        if held:
            yield flush()

    found = one_of_each(per, "copies").mapInArrow(anchors, "a long, b long, copies long, h long, x long, y long, lo long, hi long")
    found = scratch.save(found, "anchors")
    # Minimisers that stand at one place only can't belong to repeated windows.
    place = F.xxhash64("a", "b", "lo")
    again = found.groupBy("h").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p < q").select("h")
    again = scratch.save(again, "minimisers")
    cand = scratch.save(found.join(broadcast_if_small(again, again.count(), 16), "h"), "candidates")
    scratch.drop("anchors", "minimisers")
    # Texts with copies are repeated as a whole, so they need no counts, but others may repeat parts of them.
    contexts = cand.groupBy("x", "y").agg(F.sum("copies").alias("n"), *[F.first(c).alias(c) for c in ("h", "a", "b", "lo", "hi")])
    contexts = scratch.save(contexts, "contexts")
    # A context that is alone with its minimiser has no window in common with another one.
    crowds = contexts.groupBy("h").agg(F.count("*").alias("members"), F.min("n").alias("least")).filter("members > 1 and least = 1").select("h", "members")
    crowds = scratch.save(crowds, "crowds")
    crowds = broadcast_if_small(crowds, crowds.count(), 24)
    where = contexts.join(crowds, "h").groupBy("a", "b").agg(F.collect_list(F.struct("h", "members", "n", "lo", "hi")).alias("cs"))  # bounded by the text's own length
    where = scratch.save(where.join(per.select("a", "b", "rep"), ["a", "b"]), "where")
    texts = one_of_each(where, "cs").select("a", "b", "text", "cs")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, cs in zip(*batch.columns, strict=True):
                data, cs = text.as_py().encode("utf-8", "surrogatepass"), cs.values
                bytes_of = [data[lo : hi + length] for lo, hi in zip(cs.field("lo").to_pylist(), cs.field("hi").to_pylist(), strict=True)]
                same = [pa.array([x.as_py()] * len(cs), pa.int64()) for x in (a, b)]
                yield pa.record_batch([*(cs.field(f) for f in ("h", "members", "n", "lo")), *same, pa.array(bytes_of, pa.binary())], names=["h", "members", "n", "lo", "a", "b", "piece"])

    pieces = scratch.save(texts.mapInArrow(cut_out, "h long, members long, n long, lo long, a long, b long, piece binary"), "pieces")
    scratch.drop("where", "crowds")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by h; contexts of whole groups are matched together."""
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > CHUNK and row[0] != held[-1][0]:
                    yield _matched(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield _matched(held, length)

    def matched(groups: DataFrame) -> DataFrame:
        return groups.filter(F.col("members") <= CROWD).select("h", "n", "lo", "a", "b", "piece").repartition("h").sortWithinPartitions("h").mapInArrow(match, "a long, b long, lo long, ds array<int>")

    def cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of a second order of minimisers within those of the first."""
        for batch in batches:
            step = max(1, CHUNK // (2 * length))
            for i in range(0, batch.num_rows, step):
                rows = batch.slice(i, step)
                pieces = rows.column("piece").to_pylist()
                data, h2, own, lo, hi = minimisers(pieces, length, 7)
                begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])[own]
                h, n, at, a, b = (np.asarray(rows.column(c))[own] for c in ("h", "n", "lo", "a", "b"))
                with np.errstate(over="ignore"):
                    both = _mixed(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h2).view(np.int64)
                parts = [data[x:y].tobytes() for x, y in zip(lo, hi + length, strict=True)]
                names = [hashlib.blake2b(k.to_bytes(8, "little", signed=True) + p, digest_size=16).digest() for k, p in zip(both.tolist(), parts, strict=True)]
                columns = [pa.array(both), pa.array(names, pa.binary()), *(pa.array(c) for c in (n, at + lo - begin, at + hi - begin, a, b)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "ctx", "n", "lo", "hi", "a", "b", "piece"])

    crowd = pieces.filter(F.col("members") > CROWD).select("h", "n", "lo", "a", "b", "piece")
    inside = scratch.save(crowd.mapInArrow(cut_again, "h long, ctx binary, n long, lo long, hi long, a long, b long, piece binary"), "again")
    distinct = scratch.save(inside.groupBy("ctx").agg(F.sum("n").alias("n"), F.first("h").alias("h"), F.min(F.struct("a", "b", "lo", "piece")).alias("one")).select("ctx", "n", "h", "one.*"), "distinct")
    inner = scratch.save(distinct.groupBy("h").agg(F.count("*").alias("members")).filter("members > 1"), "inner")
    pieces_again = scratch.save(distinct.join(inner, "h").select("h", "members", "n", "lo", "a", "b", "piece"), "pieces-again")
    starts = matched(pieces).unionByName(matched(pieces_again))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CHUNK // (2 * length))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                x, y, own, d = window_names(part.column("piece").to_pylist(), length)
                own = pa.array(own)
                yield pa.record_batch({"x": pa.array(x.view(np.int64)), "y": pa.array(y.view(np.int64)), "d": pa.array(d), **{c: part.column(c).take(own) for c in ("n", "lo", "a", "b")}})

    # Larger groups are dealt out window by window, so no minimiser's contexts meet in one task.
    named = scratch.save(pieces_again.filter(F.col("members") > CROWD).select("n", "lo", "a", "b", "piece").mapInArrow(windows, "x long, y long, d int, n long, lo long, a long, b long"), "windows")
    often = named.groupBy("x", "y").agg(F.count("*").alias("all")).filter("all > 1").select("x", "y")
    dealt = named.filter("n = 1").join(often, ["x", "y"]).groupBy("a", "b", "lo").agg(F.collect_set("d").alias("ds"))  # bounded by the context's length
    # A context that occurs once is where its row says; others are looked up, and all their windows are repeated.
    everywhere = lambda rows, of, key: rows.join(of.filter("n > 1").select(*key), key).select("a", "b", "lo", F.lit(None).cast("array<int>").alias("ds"), "hi")
    many = everywhere(cand.filter("copies = 1"), contexts, ["x", "y"]).unionByName(everywhere(inside.filter("n = 1"), distinct, ["ctx"]))
    hit = starts.unionByName(dealt).withColumn("hi", F.col("lo")).unionByName(many)
    per_text = hit.groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi", "ds")).alias("hits"))  # bounded by the text's own length

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for hits in batch.column("hits"):
                s = np.concatenate([np.arange(c["lo"], c["hi"] + 1) if c["ds"] is None else c["lo"] + np.array(c["ds"], np.int64) for c in hits.as_py()])
                lo, hi = _ranges(np.unique(s), length)
                spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(lo, hi, strict=True)])
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "spans": pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))})

    merged = per_text.mapInArrow(merge, "a long, b long, spans array<struct<lo:long,hi:long>>")
    whole = per.filter("copies > 1").select("a", "b", F.lit(True).alias("whole"))
    marks = merged.unionByName(whole.select("a", "b", F.lit(None).cast("array<struct<lo:long,hi:long>>").alias("spans"))).withColumn("hit", F.lit(True))
    marks = scratch.save(marks, "marks")
    scratch.drop("texts", "candidates", "contexts", "pieces", "again", "distinct", "inner", "pieces-again", "windows")
    out = src.join(marks, ["a", "b"], "left")
    full = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.octet_length("text").cast("long").alias("hi")))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return out.select("doc_id", "text", F.when(F.col("hit").isNull(), none).when(F.col("spans").isNull(), full).otherwise(F.col("spans")).alias("spans"))


def remove_repeated(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data, at, parts, spans = (text.as_py() or "").encode("utf-8", "surrogatepass"), 0, [], spans.as_py()
                for s in spans:
                    parts.append(data[at : s["lo"]])
                    at = s["hi"]
                kept.append(b"".join(parts) + data[at:])
                sizes.append(len(data))
                gone.append(len(spans))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array([s - len(k) for s, k in zip(sizes, kept, strict=True)], pa.int64()), "n_spans": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return repeated_spans(docs, length).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
