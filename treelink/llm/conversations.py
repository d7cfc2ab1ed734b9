"""Repair of conversations' structure: one solution for each distinct signature of roles and faults.

A row's symbol is its role's initial (s, u, a, or x for any other), in capitals if its text is truncated, and d if it has to go. The
symbols of a conversation in order are its signature. Signatures are made by window functions in the plan; each distinct one is solved
once, by recursion over (row, role reached) with memory, and its audit, cost and replay are joined back to all conversations that share it.

Rows go by turn (nulls first), rows of one turn by role and text. Faults, of which a row's first counts: blank (nothing but white space),
duplicate (role and text seen earlier in the conversation), truncated (the last character that is no white space isn't one of `.!?`).
Edits: Keep is free, Rerole to user or assistant costs 3, Delete 4 (required for blank and duplicate rows), Insert of an empty user or
assistant row 3; a truncated row that stays costs 3 more. The roles left are an optional system row and pairs of user and assistant, or nothing.
Of the cheapest repairs the one whose audit is least in ASCII is taken.

Defined results: nulls in role and text are one space, so such a text is blank and such a role none of the three; a null conv_id is a
conversation of its own; repeated rows are duplicates; other columns are ignored, whatever their names; an empty table gives no rows. A
conversation's rows come together in one row of results by contract, so a conversation has to fit in a row (2 GB); windows before that spill.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, busy_tasks

INF = 1 << 60
#: Roles that may follow a role; the empty one is before the first.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
#: Rows between which more than two insertions could be left out again two by two.
SPARE = 2
#: Shares of a signature that is too common for one task of a join.
SALTS = 32


class Solver:
    """Cheapest edits of one signature."""

    def __init__(self, signature: str):
        self.rows, self.memory = signature, {}

    def options(self, i: int, role: str, spare: int) -> list[tuple[str, int, tuple[int, str, int]]]:
        """Edits in ASCII order: letter, cost, and where it leads."""
        found = []
        if i < len(self.rows):
            found.append(("D", 4, (i + 1, role, SPARE)))
        if spare:
            found += [("I", 3, (i, r, spare - 1)) for r in NEXT[role] if r in NAMES]
        if i < len(self.rows) and self.rows[i] != "d":
            stays = 3 if self.rows[i].isupper() else 0
            own = self.rows[i].lower()
            found += [("K", stays, (i + 1, own, SPARE))] if own in NEXT[role] else []
            found += [("R", 3 + stays, (i + 1, r, SPARE)) for r in NEXT[role] if r in NAMES]
        return found

    def cost(self, i: int, role: str, spare: int = SPARE) -> int:
        """Least cost of all that follows."""
        key = (i, role, spare)
        if key not in self.memory:
            done = 0 if i == len(self.rows) and role in ("", "a") else INF
            self.memory[key] = min([done, *[c + self.cost(*to) for _, c, to in self.options(i, role, spare)]])
        return self.memory[key]

    def solve(self) -> tuple[int, str, list[tuple[int, str | None]]]:
        """Cost, audit, and the rows to write: number of the row (-1: an inserted one) and new role (None: its own)."""
        for i in range(len(self.rows), -1, -1):  # from the end, so that no call goes deeper than a row
            for role in NEXT:
                self.cost(i, role)
        at, audit, replay = (0, "", SPARE), [], []
        left = whole = self.cost(*at)
        while left or at[0] < len(self.rows):
            letter, c, to = next(o for o in self.options(*at) if o[1] + self.cost(*o[2]) == left)
            audit.append(letter)
            if letter != "D":
                replay.append((-1 if letter == "I" else at[0], None if letter == "K" else NAMES[to[1]]))
            at, left = to, left - c
        return whole, "".join(audit), replay


def solutions(signatures: DataFrame) -> DataFrame:
    """sig, cost, audit, replay for distinct signatures."""
    replay = pa.list_(pa.struct([("at", pa.int32()), ("role", pa.string())]))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = b.column("sig").to_pylist()
            for i in range(0, len(sigs), 256):
                found = [Solver(s).solve() for s in sigs[i : i + 256]]
                rows = [[{"at": at, "role": role} for at, role in f[2]] for f in found]
                yield pa.record_batch([pa.array(sigs[i : i + 256], pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array(rows, replay)], names=["sig", "cost", "audit", "replay"])

    return signatures.mapInArrow(solved, "sig string, cost long, audit string, replay array<struct<at:int, role:string>>")


def structure(rows: DataFrame) -> DataFrame:
    """conv_id, sig, counts of faults, gaps and illegal neighbours, and rows in order (role, text), for each conversation."""
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    r = r.repartition("conv_id")  # one exchange for the windows and the grouping
    first = F.substring("role", 1, 1)
    copies = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("nth") > 1, "duplicate").when(cut, "truncated")
    r = r.withColumn("nth", copies).withColumn("fault", fault).drop("nth")
    before = F.lag(first).over(order)
    r = r.withColumn("illegal", (before.isNotNull() & ~F.concat(before, first).isin("su", "ua", "au")).cast("long")).withColumn("place", F.row_number().over(order))
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    sym = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    ordered = F.sort_array(F.collect_list(F.struct("place", sym.alias("sym"), "role", "text")))
    count = lambda f: F.sum((F.col("fault") == f).cast("long"))
    span = F.max("turn") - F.min("turn") + 1 - F.size(F.collect_set("turn"))
    per = r.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.coalesce(count(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")], F.sum("illegal").alias("illegal"), ordered.alias("rows"))
    return per.withColumn("sig", F.array_join(F.transform("rows", lambda x: x["sym"]), ""))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (`role:text` lines) for conv_id, turn, role, text."""
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession, "conversations")
    per = scratch.save(structure(conversations), "structure")
    distinct = per.select("sig").distinct().repartition(busy_tasks(spark), "sig")
    solved = scratch.save(solutions(distinct), "solutions")
    size = solved.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("sig") + 16 * F.size("replay")), F.lit(0)).alias("wide")).first()
    small = broadcast_if_small(solved, size["n"], 64 + size["wide"])
    if small is solved:  # a signature may be that of a third of all conversations
        per = per.withColumn("salt", F.pmod(F.xxhash64("conv_id", "rows"), F.lit(SALTS)))
        joined = per.join(solved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["sig", "salt"])
    else:
        joined = per.join(small, "sig")
    line = lambda x: F.concat(F.coalesce(x["role"], F.get("rows", x["at"])["role"]), F.lit(":"), F.when(x["at"] < 0, "").otherwise(F.get("rows", x["at"])["text"]))
    repaired = F.array_join(F.transform("replay", line), "\n")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", repaired.alias("repaired"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by a checksum of `conv_id:turn`: of 20 remainders 0 drops a row, 1 empties its text, 2 removes `.!?` from it, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    new = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    r = conversations.select("conv_id", "turn", "role", "text", part.alias("part"))
    r = r.filter("part <> 0").select("conv_id", "turn", F.when(F.col("part") == 4, "user").otherwise(text("role")).alias("role"), new.alias("text"), F.when(F.col("part") == 3, 2).otherwise(1).alias("times"))
    return r.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def with_lost(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """repaired, with a row of zeros and empty strings for each conversation that has no row left."""
    ids = conversations.select(F.col("conv_id").alias("original")).distinct()
    j = ids.join(repaired, ids["original"].eqNullSafe(repaired["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return j.select(F.col("original").alias("conv_id"), *counts, *[F.coalesce(c, F.lit("")).alias(c) for c in ("audit", "repaired")])
