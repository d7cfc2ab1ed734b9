"""Named datasets: a name stands for a loader of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .edges import read_csv, read_npy, read_temporal, read_text, timed_edges

Loader = Callable[[SparkSession, str], DataFrame]
_loaders: dict[str, Loader] = {}
#: Formats that any name can be registered with; loaders take the session and a path.
FORMATS: dict[str, Loader] = {"csv": read_csv, "text": read_text, "npy": read_npy, "parquet": lambda spark, path: spark.read.parquet(path)}


def register(name: str, loader: Loader | str, path: str = "") -> None:
    """Let name stand for a loader of (spark, root), or for one of FORMATS at path below the root."""
    _loaders[name] = loader if callable(loader) else lambda spark, root: FORMATS[loader](spark, f"{root}/{path or name}")


def register_temporal(name: str, files: list[str]) -> None:
    """Facts with times under name_min, name_median and name_max, by which of a pair's times counts."""
    for how in ("min", "median", "max"):
        register(f"{name}_{how}", lambda spark, root, how=how: timed_edges(read_temporal(spark, [f"{root}/{f}" for f in files]), how))


def load(spark: SparkSession, name: str, root: str) -> DataFrame:
    if name not in _loaders:
        raise ValueError(f"no dataset {name}; there are {sorted(_loaders)}")
    return _loaders[name](spark, root)
