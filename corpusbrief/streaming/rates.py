"""Request rates over event time: flags for minutes over the limit, and admission by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules
from ..operators import requests


def stream_rate_flags(
    stream: DataFrame, guest: int = rules.GUEST_PER_MINUTE, user: int = rules.USER_PER_MINUTE,
    delay: str = "2 minutes", at: str = "created_at", user_column: str = "user_id",
) -> DataFrame:
    """Flags per closed minute in append mode; requests later than ``delay`` are dropped.

    The last open minute is emitted once later requests move the watermark past it.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return requests.rate_flags(timed, guest, user, at, user_column)


_MINUTE_MS = 60_000
#: Parts that users' minutes are dealt to; a part is one call of Python for each micro-batch.
_PARTS = 256


def stream_admission(
    stream: DataFrame, guest: int = rules.GUEST_PER_MINUTE, user: int = rules.USER_PER_MINUTE,
    delay: str = "2 minutes", at: str = "created_at", user_column: str = "user_id", order: str = "id", parts: int = _PARTS,
) -> DataFrame:
    """Requests as they arrive with ``admitted``, by the limits of :func:`corpusbrief.operators.requests.admit`.

    What is decided stays decided: within a micro-batch the order is that of ``at`` and ``order``, and a minute's
    earlier batches come first. Users' minutes are dealt by hash, so the guests' requests spread by minute. State is a
    number for each user's open minute; a timer drops those that the watermark has passed. Requests later than
    ``delay``, or without a time, don't get through.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    keyed = timed.where(F.col(at).isNotNull()).withColumns(requests.rate_keys(at, user_column))
    keyed = keyed.withColumn("_part", F.pmod(F.xxhash64("_key", "_minute"), F.lit(parts)).cast("int"))
    columns = stream.columns

    def decide(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        used = {(m, o): n for m, o, n in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            found = pd.concat(list(frames)).sort_values([at, order])
            # guests, and only they, have the empty key
            owner, minute = found["_key"], found["_minute"].map(lambda m: int(m.timestamp() * 1000))
            before = np.array([used.get(k, 0) for k in zip(minute, owner)], int)
            place = before + found.groupby([minute, owner]).cumcount().to_numpy()
            found["admitted"] = place < np.where(owner == "", guest, user)
            for k, p in zip(zip(minute, owner), place.tolist()):
                used[k] = p + 1  # the last one of each minute counts
            yield found[[*columns, "admitted"]]
        still = sorted((m, o, n) for (m, o), n in used.items() if m + _MINUTE_MS > passed)
        if still:
            state.update(tuple(map(list, zip(*still))))
            state.setTimeoutTimestamp(max(still[0][0] + _MINUTE_MS, passed + 1))
        elif state.exists:
            state.remove()

    kinds = dict(timed.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", admitted boolean"
    return keyed.groupBy("_part").applyInPandasWithState(
        decide, schema, "minute array<long>, owner array<string>, used array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
