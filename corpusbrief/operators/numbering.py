"""Exact running positions over a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import landed

_PART, _AT, _FIRST, _BEFORE = "_part", "_at", "_first", "_before"


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 1, within: str | None = None) -> DataFrame:
    """Dense positions from ``start`` in the given order, restarting in each ``within`` group.

    Rows are range-partitioned and sorted, so position = position in the partition + rows of the
    group in earlier partitions. Range bounds are sampled, so the placed rows are written
    first: both uses of them, and any retry, see the same placement. The counts have one row per
    partition and group; a group of any size spreads over as many partitions as it needs.
    """
    keys = ([F.col(within)] if within else []) + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = landed(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_AT, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    groups = [within] if within else []
    counts = placed.groupBy(*groups, _PART).agg(F.count(F.lit(1)).alias("_n"), F.min(_AT).alias(_FIRST))
    earlier = W.partitionBy(*groups).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn(_BEFORE, F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    offsets = offsets.withColumnsRenamed({_PART: "_offset_part", **({within: "_offset_group"} if within else {})})
    same = F.col(_PART) == F.col("_offset_part")
    if within:
        same = same & F.col(within).eqNullSafe(F.col("_offset_group"))
    else:
        # one row per partition, which is safe to broadcast
        offsets = F.broadcast(offsets)
    position = (F.col(_AT) - F.col(_FIRST) + F.col(_BEFORE) + F.lit(start)).cast("long")
    return placed.join(offsets, same).select(*df.columns, position.alias(name))


def sums_before(df: DataFrame, within: str, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """Add, by new name, the sum of a column over the rows before each row in its group's order (0 for the first).

    No group is gathered: rows are range-partitioned by group and order, each partition adds up its own rows of a
    group, and the sums of the group's earlier partitions are put on top. The placed rows are written first,
    as in :func:`numbered`. Give it narrow rows. Within a group the order must be unique.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = landed(df.repartitionByRange(F.col(within), *keys).withColumn(_PART, F.spark_partition_id()))
    parts = placed.groupBy(within, _PART).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = W.partitionBy(within).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn(_FIRST, F.min(_PART).over(W.partitionBy(within))).select(
        F.col(within).alias("_offset_group"), F.col(_PART).alias("_offset_part"), _FIRST,
        *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in sums],
    # where a group began in an earlier partition: one group for each boundary, which is safe to broadcast
    ).where(F.col("_offset_part") > F.col(_FIRST)).drop(_FIRST)
    inside = W.partitionBy(within, _PART).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    same = (F.col(_PART) == F.col("_offset_part")) & F.col(within).eqNullSafe(F.col("_offset_group"))
    none = F.lit(0)
    return placed.join(F.broadcast(offsets), same, "left").select(*df.columns, *[
        (F.coalesce(F.sum(c).over(inside), none) + F.coalesce(F.col(f"_before_{n}"), none)).cast("long").alias(n)
        for n, c in sums.items()
    ])
