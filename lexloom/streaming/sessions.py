"""Sessions, repeats and lateness of events in event time, for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """A stream's state is dropped, and its rows count as late, behind the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if late else timed


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, first and last moment, events and total value of each session: events of a user, each at most ``gap`` after the one before.

    With ``late`` the events are a stream, and a session comes out once the watermark has passed the gap behind it.
    Events without a time or user have no session.
    """
    timed = _timed(events, late).where("ts IS NOT NULL AND user_id IS NOT NULL")
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    out = grouped.agg(F.max("ts").alias("last"), F.count("*").alias("events"), F.sum(F.coalesce(F.col("value"), F.lit(0.0)).cast("decimal(24,6)")).alias("total"))
    return out.select("user_id", F.col("w.start").alias("first"), "last", "events", F.col("total").cast("double").alias("total"))


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first of each key: in a stream, of those that come within ``late`` of each other, as keys are forgotten behind the watermark."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def late_rows(query: StreamingQuery) -> int:
    """How many rows came behind the watermark and were dropped, as far as the query remembers its progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
