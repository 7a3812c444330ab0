"""Requests arriving as a stream, carried through the batch plan one micro-batch at a time."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.generate import Provider
from ..plans.briefs import run_briefs
from ..sources.tables import HISTORY_SCHEMA, store_files  # noqa: F401  named above


def stream_briefs(
    stream: DataFrame, files: DataFrame, provider_factory: Callable[[], Provider], out_dir: str,
    checkpoint: str, tasks: int | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Run :func:`run_briefs` on each micro-batch; stages, history and rejects land in ``batch_id=N``.

    What a batch starts from, its moment and the highest id before it, is written first and read
    again if the batch is repeated, so a repeated batch gives the same ids and times. It costs one
    row a batch, whatever the age of the stream. ``files`` stored with :func:`store_files` is read
    only where the batch's repositories are.
    """

    def carry(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = f"batch_id={batch_id}"
        start = _start_of(spark, out_dir, batch_id)
        before = spark.createDataFrame([(start["last_id"],)], "id long")
        done = run_briefs(
            spark, batch, files, before, provider_factory, os.path.join(out_dir, "work", at),
            now=start["moment"], tasks=tasks,
        )
        done.rejected.write.mode("overwrite").parquet(os.path.join(out_dir, "rejected", at))
        done.history.write.mode("overwrite").parquet(os.path.join(out_dir, "history", at))
        highest = done.jobs.agg(F.max("id")).first()[0] or start["last_id"]
        _one_row(spark, highest, start["moment"]).write.mode("overwrite").parquet(os.path.join(out_dir, "ended", at))

    writer = stream.writeStream.foreachBatch(carry).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


_MARK = "last_id long, moment timestamp_ntz"


def _one_row(spark: SparkSession, last_id: int, moment: datetime) -> DataFrame:
    return spark.createDataFrame([(last_id, moment)], _MARK).coalesce(1)


def _start_of(spark: SparkSession, out_dir: str, batch_id: int) -> Row:
    """The highest id before a batch and its moment; fixed the first time the batch is tried."""
    started = os.path.join(out_dir, "started", f"batch_id={batch_id}")
    try:
        if found := spark.read.schema(_MARK).parquet(started).first():
            return found
    except AnalysisException:  # the first try
        pass
    last = 0
    if batch_id:
        ended = spark.read.schema(_MARK).parquet(os.path.join(out_dir, "ended", f"batch_id={batch_id - 1}"))
        last = ended.first()["last_id"]
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    _one_row(spark, last, now).write.mode("overwrite").parquet(started)
    return Row(last_id=last, moment=now)


def read_stream_rejects(spark: SparkSession, out_dir: str) -> DataFrame:
    """Requests the stream did not accept, with their reasons."""
    return spark.read.parquet(os.path.join(out_dir, "rejected"))


def read_stream_history(spark: SparkSession, out_dir: str) -> DataFrame:
    schema = HISTORY_SCHEMA + ", batch_id long"
    return spark.read.schema(schema).parquet(os.path.join(out_dir, "history"))
