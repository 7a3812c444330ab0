"""A history that can be changed: versioned snapshots in hash buckets of the job id.

``data/version=V/bucket=B`` holds the rows of a bucket as of version V, ``manifest/version=V`` one
row for each bucket with the version that holds it. A change writes only the buckets it touches and then
one manifest file, whose rename is the switch: readers see the old version or the new one. A change that
is repeated, or that failed before its manifest, writes the same version again. One writer at a time.

Once a change is through, what only versions before the last one used is deleted: a table that was read stays readable
until the next change but one, and the folder holds at most two copies of any bucket.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events
from ..operators.history import lookup
from ..session import discard, names_in
from .tables import HISTORY_SCHEMA

_COLUMNS = [part.split()[0] for part in HISTORY_SCHEMA.split(", ")]
_SEEN = ["last_seq", "completed_seq"]
_STORED = HISTORY_SCHEMA + ", " + ", ".join(f"{c} long" for c in _SEEN)
_MANIFEST_NAMES = ("bucket", "holder", "stream", "batch")
_MANIFEST_KINDS = (pa.int32(), pa.int64(), pa.string(), pa.int64())
_MANIFEST = "bucket int, holder long, stream string, batch long, version long"
#: The row of a manifest that is about the store: its number of buckets, and the last stream batch in it.
_ABOUT = -1

Mark = tuple[str, int]


def id_bucket(job: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class _Snapshot:
    version: int
    held: dict[int, int]
    mark: Mark | None


class HistoryStore:
    """The same path must always be opened with the same number of buckets; another one is refused."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _snapshots(self) -> list[_Snapshot]:
        """The versions there are, oldest first: three at most, with a row a bucket."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(os.path.join(self.path, "manifest")).collect()
        except AnalysisException:  # nothing stored yet
            return []
        found = []
        for version in sorted({r["version"] for r in rows}):
            mine = [r for r in rows if r["version"] == version]
            about = next(r for r in mine if r["bucket"] == _ABOUT)
            if about["holder"] != self.buckets:
                raise ValueError(f"{self.path} has {about['holder']} buckets, not {self.buckets}")
            mark = None if about["stream"] is None else (about["stream"], about["batch"])
            found.append(_Snapshot(version, {r["bucket"]: r["holder"] for r in mine if r["bucket"] != _ABOUT}, mark))
        return found

    def _current(self) -> _Snapshot:
        return (self._snapshots() or [_Snapshot(0, {}, None)])[-1]

    def _folder(self, version: int, bucket: int | None = None) -> str:
        folder = os.path.join(self.path, "data", f"version={version}")
        return folder if bucket is None else os.path.join(folder, f"bucket={bucket}")

    def _rows(self, held: dict[int, int]) -> DataFrame:
        folders = [self._folder(v, b) for b, v in sorted(held.items())]
        if not folders:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(*folders)

    def read(self) -> DataFrame:
        """All jobs as of the current version."""
        return self._rows(self._current().held).select(*_COLUMNS)

    def _touched(self, ids: DataFrame) -> set[int]:
        bucket = id_bucket(F.col("id"), self.buckets)
        return {r["b"] for r in ids.select(bucket.alias("b")).distinct().collect()}

    def near(self, ids: DataFrame) -> DataFrame:
        """The jobs of the buckets that ``ids(id)`` fall into: all that a lookup of them has to read."""
        touched = self._touched(ids)
        return self._rows({b: v for b, v in self._current().held.items() if b in touched}).select(*_COLUMNS)

    def lookup(self, asked: DataFrame) -> DataFrame:
        """:func:`corpusbrief.operators.history.lookup` of ``asked(request_id, id, user_id)``, read from their buckets."""
        return lookup(asked, self.near(asked))

    def has_applied(self, mark: Mark) -> bool:
        """Whether a batch of a stream is part of the current version."""
        last = self._current().mark
        return last is not None and last[0] == mark[0] and mark[1] <= last[1]

    def _change(self, ids: DataFrame, made: Callable[[DataFrame], DataFrame], mark: Mark | None = None) -> None:
        """Rewrite the buckets of ``ids(id)`` with what ``made`` makes of their rows."""
        snapshots = self._snapshots()
        now = snapshots[-1] if snapshots else _Snapshot(0, {}, None)
        touched = self._touched(ids)
        if not touched and mark is None:
            return
        version, filled = now.version + 1, set()
        if touched:
            bucket = id_bucket(F.col("id"), self.buckets)
            before = self._rows({b: v for b, v in now.held.items() if b in touched})
            after = made(before).select(*_COLUMNS, *_SEEN).withColumn("bucket", bucket)
            # Spark sizes the tasks: small buckets share one and a large one is split; sorted for readers by user
            dealt = after.hint("rebalance", "bucket").sortWithinPartitions("bucket", "user_id", "id")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(version))
            # a bucket all of whose rows are gone is not there
            named = (name.partition("=") for name in names_in(self.spark, self._folder(version)))
            filled = {int(number) for label, _, number in named if label == "bucket"}
        kept = {b: v for b, v in now.held.items() if b not in touched} | dict.fromkeys(filled, version)
        stream, batch = mark or now.mark or (None, None)
        rows = [(b, v, None, None) for b, v in sorted(kept.items())] + [(_ABOUT, self.buckets, stream, batch)]
        columns = zip(*rows, strict=True)
        manifest = pa.table([pa.array(c, k) for c, k in zip(columns, _MANIFEST_KINDS, strict=True)], list(_MANIFEST_NAMES))
        self.spark.createDataFrame(manifest).coalesce(1).write.mode("overwrite").parquet(self._manifest_folder(version))
        self._clean(snapshots, kept)

    def _manifest_folder(self, version: int) -> str:
        return os.path.join(self.path, "manifest", f"version={version}")

    def _clean(self, snapshots: list[_Snapshot], kept: dict[int, int]) -> None:
        """Delete what only versions before ``snapshots[-1]`` used; that one may still be read."""
        used = set(kept.items()) | set(snapshots[-1].held.items() if snapshots else ())
        versions = {v for _, v in used}
        for old in snapshots[:-1]:
            for bucket, holder in set(old.held.items()) - used:
                discard(self.spark, self._folder(holder, bucket) if holder in versions else self._folder(holder))
            # last, so that a clean-up that broke off is taken up by the next change
            discard(self.spark, self._manifest_folder(old.version))

    def put(self, jobs: DataFrame) -> None:
        """Add jobs; one whose id is stored replaces it, so a repeat is harmless. Ids are unique in ``jobs``."""
        none = F.lit(None).cast("long")
        fresh = jobs.select(*_COLUMNS, *[none.alias(c) for c in _SEEN])
        self._change(fresh, lambda old: old.join(fresh.select("id"), "id", "left_anti").select(*fresh.columns).unionByName(fresh))

    def apply(self, folds: DataFrame) -> None:
        """Apply folded status events (see fold_events); those without a job change nothing."""
        self._change(folds.select(F.col("analysis_id").alias("id")), lambda old: events.apply_events(old, folds))

    def apply_states(self, states: DataFrame, mark: Mark | None = None) -> None:
        """Merge fold states (see fold_states), and remember the stream batch they are of.

        A job keeps the numbers of the events it holds, so states may come again and in any order.
        """
        self._change(states.select(F.col("analysis_id").alias("id")), lambda old: events.apply_states(old, states), mark)

    def delete(self, ids: DataFrame) -> None:
        """Take back jobs by ``ids(id)``."""
        gone = ids.select("id").distinct()
        self._change(gone, lambda old: old.join(gone, "id", "left_anti"))
