"""Groups of a stream that are emitted once they are complete, or as partial by a timer when no row came for a time.

A group is its first n rows in order: it is complete with the n-th, and later rows change nothing. State is kept per key in RocksDB: a
count, a sum, whether the group was emitted, and the time of its timer, which every row moves on. When the watermark passes the
timer, a group that is not complete is emitted as partial and the state goes; a key that comes back after that begins a new group.
Batches must come in order of time for the first n rows to be those of the whole table; within a batch rows are ordered here.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from votemill.operators.runs import numbered

OUT = "key long, n int, total double, partial boolean"


class Completer(StatefulProcessor):
    """Rows of a key, with `place_` to order them and `value` to be added up, to at most one row of OUT a group."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "n int, total double, done boolean, timer long")

    def row(self, key, count: int, total: float, partial: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "n": [count], "total": [total], "partial": [partial]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, total, done, timer = self.group.get() if self.group.exists() else (0, 0.0, False, 0)
        if timer and timer <= timerValues.getCurrentWatermarkInMs():  # due in this batch, which brings rows first
            if not done:
                yield self.row(key, count, total, True)
            self.handle.deleteTimer(timer)
            count, total, done, timer = 0, 0.0, False, 0
        latest, first, wanted = 0, [], 0 if done else self.n - count
        for some in rows:
            latest = max(latest, int(some["ts_"].max().timestamp() * 1000))
            if wanted:
                first = heapq.nsmallest(wanted, first + list(zip(some["place_"], some["value"])))
        count, total = count + len(first), total + sum(v for _, v in first)
        complete = not done and count >= self.n
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(timer, latest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.group.update((count, total, done or complete, timer))
        if complete:
            yield self.row(key, count, total, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count, total, done, _ = self.group.get()
        self.group.clear()
        if not done:
            yield self.row(key, count, total, True)

    def close(self) -> None:
        pass


def completed(events: DataFrame, key: str, n: int, time: str = "ts", delay: str = "30 minutes", idle_ms: int = 1_800_000, order: tuple[str, ...] = ()) -> DataFrame:
    """key, n, total, partial of the groups of a stream. order: columns that part rows of equal time."""
    rows = events.withColumn("ts_", F.col(time).cast("timestamp")).withWatermark("ts_", delay).select(F.col(key).alias("key"), "value", "ts_", sortable(order).alias("place_"))
    return rows.groupBy("key").transformWithStateInPandas(Completer(n, idle_ms), OUT, "Append", "EventTime")


def sortable(order: tuple[str, ...]):
    """A text that sorts as (ts_, order...) for whole numbers that are not negative."""
    wide = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.concat(wide(F.unix_micros("ts_")), *[wide(F.col(c)) for c in order])


def completed_batch(events: DataFrame, key: str, n: int, time: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """The same over a finished table: every group's first n rows, and whether there were fewer."""
    rows = numbered(events.select(F.col(key).alias("key"), "value", F.col(time).alias("ts_"), *order), ["key"], ["ts_", *order, "value"], "k_").filter(F.col("k_") <= n)
    return rows.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.sum("value").alias("total"), (F.count("*") < n).alias("partial"))
