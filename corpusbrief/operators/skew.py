"""Group-wise operators that hold up when one key owns a large share of the rows.

AQE splits skewed joins but not skewed windows: a window puts each group in one task. Heavy groups
are therefore first reduced in salted sub-groups, by a rule that never drops a row the whole group
would keep, and then decided exactly on what is left. A group's weight, in rows or bytes, decides
only how many sub-groups it gets; there is no limit to the number of heavy groups or of sub-groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import landed

#: What one sub-group holds: rows where only rows count, bytes where they are weighed.
ROWS_EACH = 20_000
BYTES_EACH = 64 << 20
SALT = "_salt"
_SALTS = "_salts"


def find_hot_keys(df: DataFrame, key: str, each: int = ROWS_EACH, weight: Column | None = None) -> DataFrame | None:
    """Keys that weigh more than ``each``, with their number of sub-groups, or None.

    Reads the key and the weight only. The table is written, not collected: its size has no bound,
    so Spark decides how to join it.
    """
    weighed = df.groupBy(key).agg(F.sum(F.lit(1) if weight is None else weight).alias("_weight"))
    heavy = landed(weighed.where(F.col("_weight") > each).select(key, F.ceil(F.col("_weight") / each).alias(_SALTS)))
    return heavy if heavy.limit(1).count() else None


def add_salt(df: DataFrame, key: str, spread_by: Column, hot: DataFrame) -> DataFrame:
    """A salt from the row's own value for hot keys, 0 for all others; the same on every retry."""
    salted = F.pmod(F.xxhash64(spread_by), F.coalesce(F.col(_SALTS), F.lit(1)).cast("long"))
    known = hot.withColumnRenamed(key, "_hot")
    # null-safe, as rows without a key may be the largest group
    joined = df.join(known, F.col(key).eqNullSafe(F.col("_hot")), "left")
    return joined.withColumn(SALT, salted).drop(_SALTS, "_hot")


def first_per_group(
    df: DataFrame, key: str, order: list[Column], limit: int, spread_by: Column,
    hot: DataFrame | None = None, within: str | None = None,
) -> DataFrame:
    """The first ``limit`` rows of each group in the given order.

    ``within`` subdivides the groups. Spark turns the rank filter into a group limit that already
    cuts each map task's rows before the shuffle.
    """
    keys = [key] if within is None else [key, within]
    if hot is not None:
        df = _ranked(add_salt(df, key, spread_by, hot), [*keys, SALT], order, limit).drop(SALT)
    return _ranked(df, keys, order, limit)


def _ranked(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
