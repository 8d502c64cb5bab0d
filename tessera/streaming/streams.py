"""Views of the message log and the daily quota as structured streams.

Both have the results of their batch counterparts, which stay the reference.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.text import DAY_MS, utc_day

QUOTA_SCHEMA = "_id long, userId long, day string, ok boolean, count long"


def latest_per_chat(messages: DataFrame) -> DataFrame:
    """The latest message per chat so far. One row of state per chat; use complete or update mode."""
    return messages.groupBy("chatId").agg(F.max("_creationTime").alias("turn"), F.max_by("body", F.struct("_creationTime", "body")).alias("body"))


def daily_quota(requests: DataFrame, limit: int, lateness: str = "1 hour") -> DataFrame:
    """Each request with the running count of its user and UTC day, in order of time within a batch.

    State is one number per (user, day) and goes when the watermark has passed the
    day's end; requests that come later than that are dropped.
    """

    def count(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ms", "_id"])
        place = n + pd.RangeIndex(1, len(rows) + 1)
        yield pd.DataFrame({"_id": rows["_id"].to_numpy(), "userId": key[0], "day": key[1], "ok": place <= limit, "count": place.to_series().clip(upper=limit).to_numpy()})
        state.update((n + len(rows),))
        end = (int(rows["ms"].iloc[0]) // DAY_MS + 1) * DAY_MS
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    df = requests.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", lateness).withColumn("day", utc_day(F.col("ms")))
    return df.groupBy("userId", "day").applyInPandasWithState(count, QUOTA_SCHEMA, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def live_view(changes: DataFrame, view: Callable[[SparkSession], DataFrame | None], show: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A view that is worked out anew whenever ``changes`` has rows, from the tables as they are then.

    ``view`` returns None where an argument is missing; such a view isn't worked out.
    A batch that comes again shows the same view again, so ``show`` should overwrite.
    """

    def again(batch: DataFrame, number: int) -> None:
        df = None if batch.isEmpty() else view(batch.sparkSession)
        if df is not None:
            show(df, number)

    return changes.writeStream.foreachBatch(again)


def progress(query: StreamingQuery) -> dict:
    """Batches and rows so far and whether the query still runs, for a column that is polled."""
    reports = query.recentProgress
    return {"batches": len(reports), "rows": sum(int(r["numInputRows"]) for r in reports), "running": query.isActive}
