"""Continuous status fold: small idempotent deltas per micro-batch, merged when read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules
from ..operators import events
from ..session import discard, landed, names_in, shared_path
from ..sources.store import HistoryStore

STATE_SCHEMA = (
    "analysis_id long, last struct<seq: long, status: string, error: string, ts: timestamp_ntz>, "
    "completed struct<seq: long, summary: string>, batch_id long"
)


def stream_fold(
    stream: DataFrame, state_path: str, checkpoint: str, available_now: bool = True,
    rejects_path: str | None = None, compact_every: int | None = None,
) -> StreamingQuery:
    """Fold each micro-batch on its own and write the states as ``batch_id=N`` under state_path.

    A batch costs what its events cost, whatever the number of jobs so far. A repeated batch
    overwrites its own directory, so a restart changes nothing; states merge in any order. Events
    that are not accepted are written with their reasons to ``rejects_path``, if it is given.

    With ``compact_every`` each so many batches one batch also merges the states before it into its
    own. Merging is idempotent, so readers may see both; the merged ones are deleted once the next
    batch shows that the merge was committed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"batch_id={batch_id}"
        states = events.fold_states(batch)
        if compact_every:
            merged_to = batch_id // compact_every * compact_every - 1
            _drop_before(batch.sparkSession, state_path, merged_to)
            if batch_id % compact_every == compact_every - 1 and batch_id:
                earlier = batch.sparkSession.read.schema(STATE_SCHEMA).parquet(state_path).where(F.col("batch_id") < batch_id)
                states = events.merge_states(states.unionByName(earlier.drop("batch_id")))
        states.write.mode("overwrite").parquet(os.path.join(state_path, at))
        if rejects_path:
            events.validate_events(batch)[1].write.mode("overwrite").parquet(os.path.join(rejects_path, at))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_history(
    stream: DataFrame, store: HistoryStore, checkpoint: str, available_now: bool = True, rejects_path: str | None = None,
) -> StreamingQuery:
    """Merge status events into a stored history, batch by batch, the way the results worker updates its table.

    A batch is folded on its own and rewrites the buckets of the jobs it names, in one switch that also notes the
    batch. A batch that is run again finds itself noted and does nothing; were the note lost, or the
    events delivered once more by another stream, they would change nothing either (see ``apply_states``).
    Events that are not accepted, and states of jobs that are not in the history, go to ``rejects_path``
    with their reasons, if it is given; the latter by the number of the job's last event.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = (_stream_name(spark, checkpoint), batch_id)
        if store.has_applied(mark):
            return
        folded_to = shared_path(spark, "batch-states")
        states = landed(events.fold_states(batch), folded_to)
        if rejects_path:
            refused = events.validate_events(batch)[1].select("seq", "analysis_id", "status", "reject_reason")
            stored = store.near(states.select(F.col("analysis_id").alias("id")))
            unknown = events.orphan_events(states, stored).select(
                "last.seq", "analysis_id", "last.status", F.lit("unknown job").alias("reject_reason")
            )
            refused.unionByName(unknown).write.mode("overwrite").parquet(os.path.join(rejects_path, f"batch_id={batch_id}"))
        store.apply_states(states, mark)
        discard(spark, folded_to)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """What tells a stream from one that starts anew in the same folder: Spark's id in the checkpoint."""
    return spark.read.text(os.path.join(checkpoint, "metadata")).first()[0]


def _drop_before(spark: SparkSession, state_path: str, batch_id: int) -> None:
    """Delete the states of batches before a committed merge, on any file system that Spark reaches."""
    if batch_id < 1:
        return
    for name in names_in(spark, state_path):
        label, _, number = name.partition("=")
        if label == "batch_id" and number.isdigit() and int(number) < batch_id:
            discard(spark, os.path.join(state_path, name))


def read_states(spark: SparkSession, state_path: str) -> DataFrame:
    """One merged state per job over all batches so far."""
    return events.merge_states(spark.read.schema(STATE_SCHEMA).parquet(state_path))


def read_fold(spark: SparkSession, state_path: str) -> DataFrame:
    """The same rows as the batch fold over all events seen so far."""
    return events.folded(read_states(spark, state_path))


def compact_states(spark: SparkSession, state_path: str, target_path: str) -> None:
    """Merge all batches into one directory of a new state path, with the highest batch id.

    Run it between queries. The next one must keep its checkpoint, so that its batch ids go on
    above the compacted one, and write to the new path.
    """
    last = spark.read.schema(STATE_SCHEMA).parquet(state_path).agg(F.max("batch_id")).first()[0]
    merged = read_states(spark, state_path)
    merged.write.mode("overwrite").parquet(os.path.join(target_path, f"batch_id={last}"))


def running_fold(stream: DataFrame) -> DataFrame:
    """The fold as a stateful aggregation, for complete or update output mode."""
    return events.fold_events(stream)


def terminal_jobs(stream: DataFrame) -> DataFrame:
    """Each job once, at the first event that shows it COMPLETED or FAILED; the state of ended jobs is kept for good."""
    return _ended(stream).dropDuplicates(["analysis_id"])


def _ended(stream: DataFrame) -> DataFrame:
    accepted, _ = events.validate_events(stream)
    return accepted.where(F.col("status").isin(*rules.TERMINAL_STATUSES))


_ENDED = "analysis_id long, status string, ts timestamp"
#: Parts that jobs are dealt to; a part is one call of Python and one row of state.
_PARTS = 4096


def ended_jobs(
    stream: DataFrame, keep: timedelta = timedelta(days=1), delay: str = "10 minutes", parts: int = _PARTS,
) -> DataFrame:
    """(analysis_id, status, ts) of each job once, at its first terminal event, with state that goes away.

    A job has state from its end on, not before, and a timer drops it once the watermark (``delay`` behind the newest
    event) is ``keep`` past that end; until then further terminal events of the job are swallowed. So what is held
    is the jobs that ended of late, however many there ever were; one that ends again after ``keep`` is told again.
    Jobs are dealt to ``parts`` by hash, as a call of Python for each job would cost far more than its events.
    """
    kept_ms = int(keep.total_seconds() * 1000)

    def first_ends(
        key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        jobs, until = (np.array(column, np.int64) for column in (state.get if state.exists else ((), ())))
        if not state.hasTimedOut:
            found = pd.concat(list(frames)).sort_values(["ts", "seq"]).drop_duplicates("analysis_id")
            first = found[~found["analysis_id"].isin(jobs)]
            ended = first["ts"].to_numpy("datetime64[ms]").astype(np.int64)
            jobs = np.concatenate((jobs, first["analysis_id"].to_numpy(np.int64)))
            until = np.concatenate((until, np.maximum(ended + kept_ms, passed + 1)))
            yield first[["analysis_id", "status", "ts"]]
        still = until > passed
        if still.any():
            state.update((jobs[still].tolist(), until[still].tolist()))
            state.setTimeoutTimestamp(int(until[still].min()))
        elif state.exists:
            state.remove()

    timed = _ended(stream).select("analysis_id", "seq", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    dealt = timed.withColumn("_part", F.pmod(F.xxhash64("analysis_id"), F.lit(parts)).cast("int"))
    return dealt.groupBy("_part").applyInPandasWithState(
        first_ends, _ENDED, "jobs array<long>, until_ms array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
