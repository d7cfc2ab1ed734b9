"""Commands: `python -m treelink prepare|train|report ...`: from an edge table to a split, from a split to a model and its metrics, from metrics to a summary."""

from __future__ import annotations

import argparse
import dataclasses
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import graph as g
from .operators import training as t
from .scratch import Scratch, temporary
from .session import session, ship
from .sources import edges as se
from .sources import registry, results

#: Parameters of training that are flags too.
TUNED = {f.name: f for f in dataclasses.fields(t.TrainConfig) if f.name != "portable"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treelink")
    p.add_argument("--master", help="Spark master; that of spark-submit by default")
    sub = p.add_subparsers(dest="command", required=True)

    prepare = sub.add_parser("prepare", help="split an edge table into train, test and negative edges")
    prepare.add_argument("--input", required=True)
    prepare.add_argument("--format", choices=sorted(registry.FORMATS), default="parquet")
    prepare.add_argument("--out", required=True)
    prepare.add_argument("--directed", action="store_true")
    prepare.add_argument("--split-ratio", type=float, nargs="+", default=[0.9], help="share of edges in train; a folder for each")
    prepare.add_argument("--neg-ratio", type=float, default=5)
    prepare.add_argument("--seed", type=int, default=0)
    prepare.add_argument("--text", choices=["normal", "weighted"], help="also write the parts as text")

    train = sub.add_parser("train", help="train on a split, score and evaluate its test edges")
    train.add_argument("--data", required=True, help="a folder that prepare wrote")
    train.add_argument("--dataset", default="dataset", help="name in the metrics")
    train.add_argument("--split-ratio", type=float)
    train.add_argument("--variant", choices=sorted(t.DEFAULTS), default="undir")
    train.add_argument("--metrics", required=True, help="folder to which a row is appended")
    train.add_argument("--turn", type=int, default=0)
    train.add_argument("--save-score")
    train.add_argument("--save-model")
    train.add_argument("--history")
    train.add_argument("--resume", help="folder of epochs; a lost run goes on from it")
    for name, field in TUNED.items():
        kind = int if field.type in ("int", "int | None") else float
        train.add_argument("--" + name.replace("_", "-"), type=kind, help="by default that of the variant")

    report = sub.add_parser("report", help="mean and deviation over turns of each dataset and ratio")
    report.add_argument("--metrics", required=True)
    report.add_argument("--out", required=True)
    report.add_argument("--turns", type=int, nargs="*", help="expected turns; one without a row counts as missing")
    report.add_argument("--missing-as-zero", action="store_true")
    return p


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    e = registry.FORMATS[a.format](spark, a.input)
    e = Scratch(spark, "prepare").save(g.directed(g.check_edges(e)) if a.directed else g.undirected(g.check_edges(e)), "edges")
    for ratio in a.split_ratio:
        with temporary():
            s = Scratch(spark, "prepare").save(g.random_split(e, ratio, a.seed), "split")
            train = s.filter("part = 'train'").select("src", "dst")
            pos = Scratch(spark, "prepare").save(g.transductive(s.filter("part = 'test'"), train), "test")
            neg = Scratch(spark, "prepare").save(g.negatives_for(train, pos, a.neg_ratio, a.seed, strict=not a.directed), "negatives")
            out = f"{a.out}/{ratio}"
            se.write_bundle(train, pos, neg, out)
            if a.text:
                for name, part in (("train", train), ("test_pos", pos), ("test_neg", neg)):
                    se.write_text(part, f"{out}/text/{name}", weighted=a.text == "weighted")
            logging.info("%s: %s", out, g.split_stats(s).first().asDict())


def train(spark: SparkSession, a: argparse.Namespace) -> dict:
    given = {n: getattr(a, n) for n in TUNED if getattr(a, n) is not None}
    cfg = dataclasses.replace(t.DEFAULTS[a.variant], **given)
    part = lambda name: se.read_bundle(spark, a.data, name)
    test = part("test_pos").withColumn("label", F.lit(1)).unionByName(part("test_neg").withColumn("label", F.lit(0)))
    model, history = t.train(part("train"), cfg, a.variant, test, resume=a.resume)
    row = {"dataset": a.dataset, "split_ratio": a.split_ratio, "turn": a.turn, **t.evaluate(model, test)}
    results.write_metrics(spark, [{k: v for k, v in row.items() if v is not None}], a.metrics)
    if a.save_score:
        results.write_scores(model.score(test), a.save_score)
    if a.save_model:
        results.write_model(model, a.save_model)
    if a.history:
        results.write_history(spark, history, a.history)
    return row


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    results.write_summary(results.read_metrics(spark, a.metrics), ["dataset", "split_ratio"], ["roc_auc", "average_precision", "f1", "hits20", "hits50", "hits100", "mrr_opt", "mrr_pess"], a.out, a.turns, a.missing_as_zero)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or ship(session(a.master))
    {"prepare": prepare, "train": train, "report": report}[a.command](spark, a)
