"""Orders over all rows without one task that holds them all: range partitions are worked on apart and shifted by one row per partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


#: Rows of a task where the number of rows is known.
TASK_ROWS = 1 << 19


def tasks_for(spark: SparkSession, rows: int) -> int:
    """So many tasks that none has much more than TASK_ROWS of so many rows, and few where rows are few."""
    return max(1, -(-rows // TASK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (1 << 14))))


def _ranged(df: DataFrame, order: list[Column | str], rows: int | None = None) -> DataFrame:
    """df with _part, the number of its range of the order. It is saved, so that all that follows sees the same ranges. rows: of df, if known, for as many ranges as they need."""
    ranges = df.repartitionByRange(*order) if rows is None else df.repartitionByRange(tasks_for(df.sparkSession, rows), *order)
    return Scratch(df.sparkSession, "ranges").save(ranges.withColumn("_part", F.spark_partition_id()), "ranges")


def prefix_sums(df: DataFrame, order: list[Column | str], sums: dict[str, Column], rows: int | None = None) -> DataFrame:
    """df with columns that hold the sum of a value over all rows before, in an order without ties. rows: of df, if known; then tasks grow in number, not in size."""
    part = _ranged(df, order, rows)
    totals = part.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    shift = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = part if rows is None else part.repartition(2 * tasks_for(df.sparkSession, rows), "_part")  # ranges that share a task are few
    out = dealt.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_w_{n}") for n, v in sums.items()])
    out = out.join(F.broadcast(shift), "_part")  # a row per partition
    return out.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_w_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[Column | str], name: str, rows: int | None = None) -> DataFrame:
    """df with each row's number in the order, from 0."""
    return prefix_sums(df, order, {name: F.lit(1).cast("bigint")}, rows)


def smallest(df: DataFrame, key: str, want: int) -> DataFrame:
    """The `want` rows of df (a saved table) with the smallest keys, which are distinct whole numbers from 0; all, if there are fewer.

    The cut is found by counting keys in 4096 ranges, then in 4096 of the range that holds it, so no rows are sorted or brought together.
    """
    top, low, left = df.agg(F.max(key)).first()[0] or 0, 0, max(0, want)
    shift = max(0, int(top).bit_length() - 12)
    while True:
        inside = df.filter((F.col(key) >= low) & (F.col(key) < low + (4096 << shift)))
        counts = dict(inside.groupBy(F.shiftright(F.col(key) - low, shift).alias("bin")).count().collect())  # at most 4096 rows
        cut = 0
        while cut < 4096 and counts.get(cut, 0) <= left:
            left -= counts.get(cut, 0)
            cut += 1
        low += cut << shift
        if not left or not shift or cut == 4096:
            return df.filter(F.col(key) < low)
        shift = max(0, shift - 12)


def transitions(rows: DataFrame, order: list[str], value: str, count: int | None = None) -> DataFrame:
    """src, dst: value of each row and of the next one in the order; the last row has none. count: of rows, if known; then tasks grow in number, not in size."""
    part = _ranged(rows.select(*order, value), order, count)
    first = part.groupBy("_part").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    following = first.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_first"))  # a row per partition
    dealt = part if count is None else part.repartition(2 * tasks_for(rows.sparkSession, count), "_part")  # ranges that share a task are few
    pairs = dealt.withColumn("_next", F.lead(value).over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(following), "_part")
    return pairs.select(F.col(value).alias("src"), F.coalesce("_next", "_first").alias("dst")).filter("dst is not null")


def last_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the last value that isn't null, of a row's own and all before it in an order without ties."""
    part = _ranged(df, order)
    last = part.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    carried = last.select("_part", F.last("_last", ignorenulls=True).over(ahead).alias("_last"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = part.withColumn("_own", F.last(value, ignorenulls=True).over(within)).join(F.broadcast(carried), "_part")  # a row per partition
    return out.select(*df.columns, F.coalesce("_own", "_last").alias(name))


#: Entries of next_fit that the driver walks along by itself; more of them are followed by joins.
WALKED = 1 << 20


def next_fit(df: DataFrame, order: list[str], cost: str, cap: int, name: str) -> DataFrame:
    """df with the number of the group that each row is packed into: in the order (without ties), a group takes rows while their costs
    add up to cap at most; a row above cap is a group by itself, and rows of no cost are left out.

    A group ends where the running sum first exceeds that before its start by more than cap, so the start of the next one is a function of
    the start. Each range of the order works this out for its own rows by doubling jumps; what can happen between ranges is a table of the
    few rows of each range that may be the first to start a group there, with the range and row where the chain goes on. The chain
    through that table (from the first row of all) is followed by the driver if it is small, and by joins that double its jumps if not.
    """
    part = _ranged(df.filter(F.col(cost) > 0), [*order])
    sizes = sorted(part.groupBy("_part").agg(F.sum(cost).alias("total")).collect())  # a row per partition
    if not sizes:
        return part.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    numbers = np.array([r["_part"] for r in sizes])
    ends = np.cumsum([r["total"] for r in sizes])
    begins = np.r_[0, ends[:-1]]
    place = {int(n): i for i, n in enumerate(numbers)}

    def chained(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A range's number, sums before and after its rows, and the next start of each row (the range's length beyond it)."""
        at = place[rows["_part"][0].as_py()]
        after = begins[at] + np.cumsum(np.asarray(rows[cost]).astype(np.int64))
        before = np.r_[begins[at], after[:-1]]
        following = np.maximum(np.searchsorted(after, before + cap, side="right"), np.arange(len(after)) + 1)
        return at, before, after, following, np.minimum(following, len(after))

    def entries(rows: pa.Table) -> pa.Table:
        """Rows that may start a range's first group: row, sum after it, groups that start in the range from there, the sum that the last of them ends at, and the range where that is."""
        at, before, after, _, jump = chained(rows.sort_by([(c, "ascending") for c in order]))
        n = len(after)
        last = np.where(jump == n, np.arange(n), jump % n)
        hops = (jump < n).astype(np.int64)
        while (hops[last] > 0).any():
            hops, last = hops + hops[last], last[last]
        window = np.arange(n)[: 1 if at == 0 else max(1, int(np.searchsorted(before, begins[at] + cap)))]
        limit = before[last[window]] + cap
        return pa.table({"at": np.full(len(window), at), "row": window, "after": after[window], "starts": hops[window] + 1, "limit": limit, "to": np.maximum(np.searchsorted(ends, limit, side="right"), at + 1)})

    scratch = Scratch(df.sparkSession, "next-fit")
    columns = part.select("_part", *order, cost)
    table = scratch.save(columns.groupBy("_part").applyInArrow(entries, "at long, row long, after long, starts long, limit long, to long"), "entries")
    reached = _walk(table, len(numbers)) if table.count() <= WALKED else _lift(scratch, table, len(numbers))
    first, starts = np.full(len(numbers), -1), np.zeros(len(numbers), np.int64)
    for at, row, n in reached:
        first[at], starts[at] = row, n
    base = np.cumsum(starts) - starts

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        at, _, after, following, _ = chained(rows)
        opened, i = [], int(first[at])
        while 0 <= i < len(after):
            opened.append(i)
            i = int(following[i])
        group = base[at] + np.searchsorted(opened, np.arange(len(after)), side="right") - 1
        return rows.drop_columns(["_part"]).append_column(name, pa.array(group.astype(np.int64)))

    types = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return part.select(*df.columns, "_part").groupBy("_part").applyInArrow(packed, f"{types}, `{name}` bigint")


def _walk(table: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """The entries that the chain meets (range, row, groups that start there), for a table of at most WALKED rows."""
    rows = table.toPandas().sort_values(["at", "row"])
    by = {int(at): g for at, g in rows.groupby("at")}
    at, i, found = 0, 0, []
    while at < ranges:
        entry = by[at].iloc[i]
        found.append((at, int(entry["row"]), int(entry["starts"])))
        at = int(entry["to"])
        if at < ranges:
            i = int(np.searchsorted(by[at]["after"].to_numpy(), entry["limit"], side="right"))
    return found


def _lift(scratch: Scratch, table: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """What _walk finds, by joins: each entry's next one, then jumps of 1, 2, 4 ... entries, each applied to all that were reached."""

    def resolved(left: pa.Table, right: pa.Table) -> pa.Table:
        """The entry of the range that a chain comes to."""
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("at", "row", "to", "to_row")})
        right = right.sort_by("row")
        i = np.searchsorted(np.asarray(right["after"]), np.asarray(left["limit"]), side="right")
        return pa.table({"at": left["at"], "row": left["row"], "to": left["to"], "to_row": np.asarray(right["row"])[i]})

    inner = table.filter(F.col("to") < ranges).select("at", "row", "limit", "to")
    jump = inner.groupBy("to").cogroup(table.select(F.col("at").alias("to"), "row", "after").groupBy("to")).applyInArrow(resolved, "at long, row long, to long, to_row long")
    key = lambda a, b: F.struct(F.col(a).alias("at"), F.col(b).alias("row"))
    jump = scratch.save(jump.select(key("at", "row").alias("a"), key("to", "to_row").alias("b")), "jump-0")
    reached = scratch.save(table.filter("at = 0").select(key("at", "row").alias("a")), "reached-0")
    for k in range(max(1, ranges.bit_length())):
        reached = scratch.save(reached.unionByName(reached.join(jump, "a").select(F.col("b").alias("a"))).distinct(), f"reached-{k + 1}")
        twice = jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        jump = scratch.save(twice, f"jump-{k + 1}")
    met = reached.select("a.at", "a.row").join(table, ["at", "row"]).select("at", "row", "starts")
    return [(r["at"], r["row"], r["starts"]) for r in met.collect()]  # a row per partition at most
