"""Shared helpers of the operators: tables, row keys and words; with those of the library for scratch tables and size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, broadcast_if_small, temporary

__all__ = ["Scratch", "broadcast_if_small", "busy_tasks", "free_name", "lower_ascii", "table", "temporary", "text_key", "words_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def busy_tasks(spark: SparkSession) -> int:
    """Number of tasks for rows that are few bytes but dear to work on; adaptive execution would put them together by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def text_key(text: str | Column = "text") -> Column:
    """A second key beside doc_id: rows that agree in doc_id and text are one document."""
    return F.xxhash64(F.lit(7), F.col(text) if isinstance(text, str) else text)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A word: digits, a-z and everything beyond ASCII, after lower_ascii.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def free_name(df: DataFrame, base: str) -> str:
    """A name that no column of df has."""
    name, taken = f"_{base}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
