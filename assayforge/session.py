"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "assayforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings; ``master`` only for local runs.

    Partition counts are left to the cluster: pass ``spark.sql.shuffle.partitions`` and
    ``spark.sql.files.maxPartitionBytes`` (the counterpart of a scan batch size) as keywords
    with dots written as double underscores, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a temporary folder; a cluster must name one,
    since a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="assayforge-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below that of the ``scratch`` block around the call."""
    base = _scratch.get() or shared_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``new_folder`` named; other paths are refused."""
    if not path.startswith(f"{shared_dir(spark).rstrip('/')}/"):
        raise ValueError(f"not below the shared folder: {path}")
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that operators write between their steps inside the block are removed when it ends, in error too.

    A result has to be written elsewhere, or collected, inside the block: DataFrames are read when they are used.
    Checkpoints go when Spark's cleaner finds them unused (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    folder = new_folder(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        remove_folder(spark, folder)


def pinned(df):
    """``df`` written out once through a reliable checkpoint, so later uses read the same rows.

    Cuts the lineage between rounds of an iterative job and fixes partition numbers before they
    are used in two places; the files survive the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()
