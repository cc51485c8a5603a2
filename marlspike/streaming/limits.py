"""Rate limits and throttles: rolling counts in batch, and the same limiter as a stateful stream."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from marlspike.operators.folds import fold

# An hour, 20 requests, a minute.
HOUR_US, MOST, MINUTE_US = 3_600_000_000, 20, 60_000_000


def rate_limited(events: DataFrame, key: str, us: str, most: int = MOST, window_us: int = HOUR_US) -> DataFrame:
    """``events`` with n (requests of the key within the window, this and rejected ones counted) and limited (n > most).

    An event that is exactly as old as the window doesn't count. One sort by key and time; no self-join.
    """
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-(window_us - 1), 0)
    return events.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("limited", F.col("n") > most)


def rolling_sum(events: DataFrame, key: str, us: str, value: str, window_us: int = MINUTE_US) -> DataFrame:
    """``events`` with the sum of ``value`` over the window, its far end included."""
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-window_us, 0)
    return events.withColumn("rolling", F.sum(value).over(w))


def throttle_waits(events: DataFrame, key: str, tokens_per_minute: int, gap_us: int) -> DataFrame:
    """(key, seq, start_us, wait_us): when each request may start on a simulated clock, by token budget and request gap.

    events: key, seq, us (asked), tokens. Order-dependent, so a key is one fold, which holds a minute's requests.
    """

    def step(s: dict, r: dict) -> list[tuple]:
        held = s["held"]
        now = r["us"] if s["last"] is None else max(r["us"], s["last"] + gap_us)
        while held:
            while held and now - held[0][0] > MINUTE_US:  # starts are in order
                s["total"] -= held.popleft()[1]
            if not held or s["total"] + r["tokens"] <= tokens_per_minute:
                break
            now = held[0][0] + MINUTE_US + 1
        held.append((now, r["tokens"]))
        s["total"] += r["tokens"]
        s["last"] = now
        return [(r[key], r["seq"], now, now - r["us"])]

    rows = events.select(key, *(F.col(c).cast("long").alias(c) for c in ("seq", "us", "tokens")))
    return fold(rows, key, ["us", "seq"], lambda: {"held": deque(), "total": 0, "last": None}, step, f"{key} {events.schema[key].dataType.simpleString()}, seq long, start_us long, wait_us long")


class _Limiter(StatefulProcessor):
    """Keeps each key's times within the window; a key that is idle for as long is forgotten."""

    def __init__(self, most: int, window_us: int):
        self.most, self.window_us = most, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", StructType([StructField("us", LongType())]), ttlDurationMs=max(1, self.window_us // 1000))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802  the base class's name
        times = [t[0] for t in self.times.get()] if self.times.exists() else []
        out = []
        for pdf in rows:
            for r in pdf.sort_values(["us", "event_id"]).itertuples():
                times = [t for t in times if r.us - t < self.window_us]
                times.append(int(r.us))
                out.append((key[0], int(r.event_id), int(r.us), len(times), len(times) > self.most))
        self.times.put([(t,) for t in times])
        yield pd.DataFrame(out, columns=["user_id", "event_id", "us", "n", "limited"])

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, most: int = MOST, window_us: int = HOUR_US) -> DataFrame:
    """The limiter on a stream (user_id, event_id, us) whose events arrive in the order of their times.

    What it holds is bounded by the keys and requests of one window: state of idle keys expires with the window, in the place of
    forgetting all keys at once beyond some number of them.
    """
    return events.groupBy("user_id").transformWithStateInPandas(_Limiter(most, window_us), "user_id long, event_id long, us long, n long, limited boolean", "Append", "ProcessingTime")
