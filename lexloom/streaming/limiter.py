"""Sliding-log admission: so many accepted requests within a window, for batch and stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """event_id, user_id and the attempts of the trailing window, this one included.

    An event counts in its own span of time and in the next, so that a user's history is never in one task.
    """
    width = seconds * 1_000_000
    at = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    span = F.floor(F.col("at") / width)
    both = at.select("*", span.alias("own"), F.explode(F.array(span, span + 1)).alias("span"))
    w = Window.partitionBy("user_id", "span").orderBy("at").rangeBetween(-width, 0)
    return both.withColumn("used", F.count("*").over(w)).where("own = span").select("event_id", "user_id", "used")


def _admit(log: deque, ts: float, limit: int, seconds: int) -> tuple[bool, int]:
    while log and log[0] <= ts - seconds:
        log.popleft()
    used = len(log)
    if used < limit:
        log.append(ts)
    return used < limit, used


OUT = "event_id long, user_id long, allowed boolean, used int"


def admit(events: DataFrame, limit: int = 8, seconds: int = 3600) -> DataFrame:
    """allowed and used of every event in time order; only accepted events count.

    A user's events are cut where nothing came for the window, as the log is empty then.
    Each stretch is read in order, batch by batch, with only the log carried along.
    """
    rows = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    rows = rows.withColumn("span", F.floor(F.col("at") / seconds))
    spans = rows.groupBy("user_id", "span").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("user_id").orderBy("span")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(order) >= seconds, F.lit(True)).cast("long")
    stretch = spans.withColumn("fresh", fresh).select(F.col("user_id").alias("owner"), F.col("span").alias("part"), F.sum("fresh").over(order).alias("stretch"))
    dealt = rows.join(stretch, F.col("user_id").eqNullSafe(F.col("owner")) & (F.col("span") == F.col("part")))
    dealt = dealt.select("event_id", "user_id", "stretch", "at").repartition("user_id", "stretch").sortWithinPartitions("user_id", "stretch", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = None, deque()
        for batch in batches:
            allowed, used = [], []
            for user, part, at in zip(batch["user_id"], batch["stretch"], batch["at"], strict=True):
                key = (None if pd.isna(user) else user, part)
                if key != now:
                    now, log = key, deque()
                yes, n = _admit(log, at, limit, seconds)
                allowed.append(yes)
                used.append(n)
            yield pd.DataFrame({"event_id": batch["event_id"], "user_id": batch["user_id"], "allowed": allowed, "used": used})

    return dealt.mapInPandas(run, OUT)


def _decide(rows: pd.DataFrame, log: deque, limit: int, seconds: int) -> pd.DataFrame:
    found = [_admit(log, t, limit, seconds) for t in rows["at"]]
    return pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "allowed": [a for a, _ in found], "used": [u for _, u in found]})


def admit_stream(events: DataFrame, limit: int = 8, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """The same over a stream, in order of arrival by batch and of time within a batch.

    Time is that of the events: a user's log is dropped once the watermark has passed the window behind its
    last event, whenever that is processed. Events that come later than ``late`` are dropped by the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else [])
        rows = pd.concat(batches).sort_values(["at", "event_id"])
        out = _decide(rows, log, limit, seconds)
        state.update((list(log),))
        ends = int((max([*log, rows["at"].max()]) + seconds) * 1000) + 1
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield out

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("event_id", "user_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, OUT, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def event_windows(events: DataFrame, width: str = "1 day") -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total"
    )
