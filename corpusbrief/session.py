"""Session defaults, the shared folder, and reliable lineage cuts."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app_name: str = "corpusbrief", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew joins and UTC; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="corpusbrief-"), package.name), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def is_local(master: str) -> bool:
    """One JVM does all the work, so that a folder of this machine is a shared one."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints; where none is set, a local one if the master is local.

    On a cluster each executor would write to its own disk, so there it is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="corpusbrief-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def landed(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a result as a table in reliable storage and go on from there.

    Cuts the lineage: a lost executor repeats no earlier work, and later readers take only the
    columns they need. Computes the input once, where a checkpoint runs its last stage twice.
    """
    target = path or shared_path(df.sparkSession, "landed")
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run meanwhile goes to Python in Arrow batches of about ``size`` bytes; then the session's own size holds again.

    An executor has the buffers of whole batches beside its heap, and so has each of its Python workers; what is free
    again mostly stays with the process.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, f"{size}b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that nothing refers to any more. It does so when the driver collects its
    garbage, which a driver with little to do puts off while the executors' disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, on any file system that Spark reaches."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, on any file system that Spark reaches; none where there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [found.getPath().getName() for found in files.listStatus(folder)] if files.exists(folder) else []
