"""Fixture graphs derived from the tables, and their SQL.

GE: transitions between users of consecutive events; GC: customers and parts of their orders; GP: suppliers and parts with times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import transitions


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ge(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return transitions(events, ["ts", "event_id"], "user_id", events.count())


def gc(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return e.select(F.col("o_custkey").cast("bigint").alias("src"), (F.col("l_partkey") + 1_000_000_000).cast("bigint").alias("dst"))


def gp(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("src"), F.col("l_partkey").cast("bigint").alias("dst"), days.cast("bigint").alias("t"))


GE = "ge AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL), e AS (SELECT DISTINCT src, dst FROM ge)"
GC = "gc AS (SELECT DISTINCT o_custkey::bigint AS src, (l_partkey + 1000000000)::bigint AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
GP = "gp AS (SELECT l_suppkey::bigint AS src, l_partkey::bigint AS dst, datediff('day', date '1995-01-01', l_shipdate::date) AS t FROM lineitem)"
ND = "nd AS (SELECT src AS node FROM ge UNION SELECT dst FROM ge)"
BITS = "CASE WHEN xor({a}, {b}) = 0 THEN 0 ELSE length(bin(xor({a}, {b}))) END"


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::bigint"


def split_sql(of: str, rounding: str = "round_even(count(*) * 0.5::double, 0)") -> str:
    return f"s AS (SELECT src, dst, CASE WHEN row_number() OVER (ORDER BY {draw_sql('1', 'src', 'dst')}, src, dst) <= (SELECT {rounding} FROM {of}) THEN 'train' ELSE 'test' END AS part FROM {of})"
