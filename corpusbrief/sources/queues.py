"""FIFO work queues as directories of files, read and written by Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import rules
from ..session import discard


def queue_path(root: str, queue: str) -> str:
    if queue not in rules.QUEUES:
        raise ValueError(f"unknown queue {queue!r}, expected one of {rules.QUEUES}")
    return os.path.join(root, queue)


def read_queue(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_queue(df: DataFrame, path: str, checkpoint: str | None = None, fmt: str = "parquet") -> StreamingQuery | None:
    """Emit rows to the next stage: a batch append, or an available-now stream when df streams."""
    if not df.isStreaming:
        df.write.mode("append").format(fmt).save(path)
        return None
    if not checkpoint:
        raise ValueError("a streaming queue write needs a checkpoint directory")
    return (
        df.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


_FILE = "_taken_from"


def drain_queue(
    spark: SparkSession, path: str, schema: str | StructType, handle: Callable[[DataFrame, int], None], checkpoint: str,
    fmt: str = "parquet", files_per_trigger: int | None = None,
) -> None:
    """Hand the messages of a queue to ``handle(batch, batch_id)``, each once, and take them off the queue.

    A batch's files are noted before it is handled and deleted once it is committed: when the next batch starts, or
    when all that was there is through. A pass that breaks off leaves its messages; the next one, with the same
    checkpoint, handles an unfinished batch again under its number and deletes what was finished before.
    """
    taken = checkpoint.rstrip("/") + "-taken"

    def take(batch: DataFrame, batch_id: int) -> None:
        _acknowledge(spark, taken, batch_id)
        batch.select(_FILE).distinct().write.mode("overwrite").parquet(os.path.join(taken, f"batch_id={batch_id}"))
        handle(batch.drop(_FILE), batch_id)

    named = read_queue(spark, path, schema, fmt, files_per_trigger).withColumn(_FILE, F.col("_metadata.file_path"))
    query = named.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    _acknowledge(spark, taken, None)


def _acknowledge(spark: SparkSession, taken: str, before: int | None) -> None:
    """Delete the files that committed batches took, then the notes of it; a repeat finds nothing left to do."""
    try:
        notes = spark.read.schema(f"{_FILE} string, batch_id long").parquet(taken)
    except AnalysisException:  # nothing taken yet
        return
    finished = notes if before is None else notes.where(F.col("batch_id") < before)
    for row in finished.select(_FILE).toLocalIterator():
        uri = spark._jvm.java.net.URI(row[_FILE])
        discard(spark, spark._jvm.org.apache.hadoop.fs.Path(uri).toString())
    for row in finished.select("batch_id").distinct().toLocalIterator():
        discard(spark, os.path.join(taken, f"batch_id={row['batch_id']}"))
