"""Sessions, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC; master and partitions only where given, so a cluster's own settings hold."""
    builder = SparkSession.builder.appName("treelink")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python functions find it there."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="treelink-"), "treelink_package.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, f"{here.name}/{p.relative_to(here)}")
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark
