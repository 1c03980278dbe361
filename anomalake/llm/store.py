"""Shared storage for jobs of several steps: tables that cut lineage, and archive files that every executor can read.

A :class:`Workspace` is a folder of its own below ``spark.checkpoint.dir`` (read from the session; only where it
is unset, as in tests, a folder below /tmp/checkpoints is used and set). Tables written here survive the loss of
executors, unlike blocks kept by ``localCheckpoint``. The folder goes when the Python process ends or on ``close()``.

Rows that go to Python travel in batches of at most ``ARROW_BYTES``: a batch is held several times over by both sides.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, where the session leaves Spark's default of 64 MB.
ARROW_BYTES = 4 << 20
_OPEN: dict[str, Workspace] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, of ``setCheckpointDir``.

    Where neither is set, one below /tmp on a local master (one host, as in tests), and an error on a cluster, whose
    hosts don't see each other's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = os.path.dirname(held.get())
        elif spark.sparkContext.master.split("[")[0] == "local":
            path = "file:/tmp/checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts of the cluster share")
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``ARROW_BYTES``, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, f"{ARROW_BYTES}b")


class Workspace:
    """A run's own folder in the shared store."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/anomalake-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _OPEN[self.root] = self  # held until it is closed, so that the folder goes also where the caller forgets it
        bounded_batches(spark)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> str:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns what was written: the lineage ends here."""
        return self.spark.read.schema(df.schema).parquet(self.save(df, name))

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        _OPEN.pop(self.root, None)
        self.delete(self.root)


def _sweep() -> None:
    for w in list(_OPEN.values()):
        try:
            w.close()
        except Exception:  # noqa: BLE001  the session may already be gone; its shared folder is then cleared by its owner
            continue


atexit.register(_sweep)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
