"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes documents (doc_id, text and any other columns, whatever their names) and returns the same columns, the last one pieces.
Defined results of every stage: an empty table stays empty; null and empty texts and rows with a null doc_id are kept unless a stage
says otherwise; rows that repeat doc_id and text are judged alike; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelink.llm.common import Scratch, free_name, table, temporary, text_key
from treelink.llm.decontaminate import decontaminate
from treelink.llm.line_dedup import dedup_lines
from treelink.llm.near_join import keep_one_per_group
from treelink.llm.packing import pack_power_of_two
from treelink.llm.queries import tokenizer_path
from treelink.llm.toxicity import drop_toxic, learn_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the lexicon predicts to be toxic. Null and empty texts never are; without labels nothing goes."""
    lexicon = learn_lexicon(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return drop_toxic(docs, lexicon)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated runs of two lines and more, and of lines of 50 words and more; documents of which no line is left go.

    n_chars, where documents have it, becomes the length of what is left. Documents without a line stay as they are.
    """
    before, removed = free_name(docs, "lines"), free_name(docs, "removed")
    kept = dedup_lines(docs, min_lines=2, min_words=50, counts=(before, removed)).filter((F.col(removed) == 0) | (F.col(removed) < F.col(before)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that Jaccard links join, that of the smallest doc_id. Texts without words are in no group."""
    return keep_one_per_group(docs, threshold=0.8, shingle=5).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of the benchmark; without a benchmark nothing goes."""
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10).filter(F.size("hits") > 0).select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(hit["_bad"]) & (text_key(docs["text"]) == hit["_bad_key"])
    return docs.join(hit, same, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their ids; a null or empty text is the end token alone."""
    return pack_power_of_two(docs, tokenizer_path(), max_len=2048, end_id=1, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("decontamination", benchmark),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written as Parquet and read again, and what it needed besides is dropped."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs


#: Tokenizing and the learned lexicon are beyond SQL.
ORACLE_SQL = None
