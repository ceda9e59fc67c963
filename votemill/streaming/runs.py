"""Streams with state by key: a breaker that opens after failures in a row, and the first row of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from votemill.streaming.completion import sortable

TRIP = "key long, handled long, streak long, place string"


class Breaker(StatefulProcessor):
    """Per key the failures in a row so far; the row that makes them more than the limit comes out, once."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", "handled long, streak long, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        handled, streak, opened = self.state.get() if self.state.exists() else (0, 0, False)
        if opened:
            return
        for place, failed in sorted((p, f) for some in rows for p, f in zip(some["place_"], some["failed"])):
            handled, streak = handled + 1, streak + 1 if failed else 0
            if streak > self.limit:
                opened = True
                yield pd.DataFrame({"key": [key[0]], "handled": [handled], "streak": [streak], "place": [place]})
                break
        self.state.update((handled, streak, opened))

    def close(self) -> None:
        pass


class First(StatefulProcessor):
    """The first row (by place) of the batch in which a key comes for the first time."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("seen", "place string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            return
        place = min(p for some in rows for p in some["place_"])
        self.state.update((place,))
        yield pd.DataFrame({"group": [key[0]], "key": [key[1]], "place": [place]})

    def close(self) -> None:
        pass


def breakers(events: DataFrame, key: str, failed: Column, limit: int, time: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """key, handled, streak and place of the row that opens each key's breaker. Batches must come in order of time."""
    rows = events.withColumn("ts_", F.col(time).cast("timestamp")).select(F.col(key).alias("key"), failed.alias("failed"), sortable(order).alias("place_"))
    return rows.groupBy("key").transformWithStateInPandas(Breaker(limit), TRIP, "Append", "None")


def first_seen(events: DataFrame, group: str, key: str, time: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """group, key and place of the first row of each (group, key). Batches must come in order of time."""
    rows = events.withColumn("ts_", F.col(time).cast("timestamp")).select(F.col(group).alias("group"), F.col(key).alias("key"), sortable(order).alias("place_"))
    return rows.groupBy("group", "key").transformWithStateInPandas(First(), "group string, key long, place string", "Append", "None")
