"""Tables in the folder that all executors share: cuts of lineage that survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_live: list[Scratch] = []
#: Spark's setting that drops an execution's shuffle files at its end instead of when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side of a join is broadcast only if the rows that were counted, times their width, stay below this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only a local master without that setting (tests) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="treelink-")
    return _own_dirs[sc.applicationId]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_lock, _writes = threading.Lock(), {}


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The session drops shuffle files at the end of executions as long as any thread writes."""
    key = id(spark)
    with _lock:
        n, before = _writes.get(key, (0, spark.conf.get(CLEANUP, "false")))
        _writes[key] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writes[key]
            _writes[key] = (n - 1, before)
            if n == 1:
                del _writes[key]
                spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and lost executors cost only their tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.thread = threading.get_ident()
        self.tables: dict[str, str] = {}
        _live.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, let Spark delete the shuffle files that the write needed, and read it back."""
        with _cleaning(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, keys: list[str], by: str | None = None, placed: bool = False) -> DataFrame:
        """As save, in as many buckets of keys as the session has shuffle partitions: joins and sums by keys need no shuffle of such a table. by: a column whose values get folders of their own, so that a filter on it reads only these. placed: df is dealt out by keys already, so it isn't shuffled once more."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables[name] = f"treelink_{uuid.uuid4().hex}"
        with _cleaning(self.spark):
            w = (df if placed else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys)
            (w.partitionBy(by) if by else w).option("path", self.path(name)).saveAsTable(self.tables[name], format="parquet")
        return self.spark.table(self.tables[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            delete_path(self.spark, self.path(name))

    def end(self) -> None:
        """Drop all tables; frames that read them are of no more use."""
        if self in _live:
            _live.remove(self)
            self.drop(*list(self.tables))
            delete_path(self.spark, self.root)


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Tables that this thread saves for frames inside go at its end. Write or count what you want of these frames before that."""
    before = set(map(id, _live))
    try:
        yield
    finally:
        for s in [s for s in _live if id(s) not in before and s.thread == threading.get_ident()]:
            s.end()


@atexit.register
def release() -> None:
    """Drop all tables that frames of this process still read, as a long-lived driver may do between queries."""
    for s in list(_live):
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            s.end()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and renamed."""
    jvm = spark.sparkContext._jvm
    target, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the counted size allows it, else the plain frame for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
