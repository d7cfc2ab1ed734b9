"""Sinks of scores, models, metrics, summaries and history, and readers of what later steps need."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import run_grid, run_summary
from ..operators.training import Model, TrainConfig


def write_scores(scored: DataFrame, path: str) -> None:
    """src, dst, label, score as Parquet."""
    scored.select("src", "dst", "label", "score").write.mode("overwrite").parquet(path)


def write_model(model: Model, path: str) -> None:
    """Coordinates by vector, degrees, and one row of parameters, as Parquet tables in one folder."""
    for name, v in model.vectors.items():
        v.select("node", "z").write.mode("overwrite").parquet(f"{path}/vectors/{name}")
    model.deg.write.mode("overwrite").parquet(f"{path}/degrees")
    row = (model.variant, ",".join(model.vectors), json.dumps(dataclasses.asdict(model.cfg)))
    model.deg.sparkSession.createDataFrame([row], "variant string, vectors string, config string").write.mode("overwrite").parquet(f"{path}/params")


def read_model(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(f"{path}/params").first()
    vectors = {name: spark.read.parquet(f"{path}/vectors/{name}") for name in row["vectors"].split(",")}
    return Model(row["variant"], vectors, spark.read.parquet(f"{path}/degrees"), TrainConfig(**json.loads(row["config"])))


def write_metrics(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Rows of names and metrics, appended as CSV with a header."""
    spark.createDataFrame(rows).coalesce(1).write.mode("append").csv(path, header=True)  # a row per run


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def write_summary(runs: DataFrame, by: list[str], metrics: list[str], path: str, turns: list[int] | None = None, missing_as_zero: bool = False) -> None:
    """run_summary as CSV with a header; turns: those that every group should have a row of."""
    runs = run_grid(runs, by, "turn", turns) if turns else runs
    run_summary(runs, by, metrics, missing_as_zero).coalesce(1).write.mode("overwrite").csv(path, header=True)  # a row per dataset and ratio


def write_history(spark: SparkSession, history: list[dict], path: str) -> None:
    """Epochs' losses, and metrics where they were evaluated, as Parquet."""
    names = sorted({k for row in history for k in row if k != "epoch"})
    rows = [(row["epoch"], *[float(row[k]) if k in row else None for k in names]) for row in history]
    spark.createDataFrame(rows, "epoch int" + "".join(f", {k} double" for k in names)).write.mode("overwrite").parquet(path)
