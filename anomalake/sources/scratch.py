"""Folders of a run in the storage that all hosts share, and files written into them by the tasks."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the process ends.

    Where that is unset, below the folder of ``setCheckpointDir``, and on a local master below /tmp; elsewhere an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts of the cluster share")
        root = os.path.dirname(held.get()) if held.isDefined() else "file:/tmp/checkpoints"
    path = f"{root.rstrip('/')}/anomalake-{name}-{uuid.uuid4().hex[:12]}"
    _MADE[path] = spark
    return path


@atexit.register
def _sweep() -> None:
    for path, spark in _MADE.items():
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may already be gone; its shared folder is then cleared by its owner
            continue


def write_files(files: DataFrame, root: str) -> int:
    """Writes a file a row of (rel string, content string) below root; the number of files. Files that a retried task wrote before are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if root.startswith("file:"):
            store, base = fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
        elif "://" in root:
            store, base = fs.FileSystem.from_uri(root)
        else:
            store, base = fs.LocalFileSystem(), root
        for b in batches:
            for rel, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{base}/{rel}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return files.select("rel", F.coalesce("content", F.lit(""))).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
