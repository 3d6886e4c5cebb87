"""Rate limits of a stream of events: the same verdicts as the window over a whole table, with a bounded state."""

from __future__ import annotations

import sys
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow.session import ship


class Limiter(StatefulProcessor):
    """Keeps the times of a key's last events: of those within the window no more than decide the next verdict, one more than are allowed.

    A timer at the end of the last event's window drops them when the watermark has passed it.
    """

    def __init__(self, seconds: int, most: int) -> None:
        self.span, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.times.get()] if self.times.exists() else []
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        counts = []
        for at in events["at"].tolist():
            insort(held, at)
            counts.append(min(bisect_right(held, at) - bisect_right(held, at - self.span), self.most + 1))
            held = held[bisect_right(held, held[-1] - self.span) :][-self.most - 1 :]
        self.times.put([(at,) for at in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(held[-1] + self.span) // 1000))
        yield pd.DataFrame({"event_id": events["event_id"].to_numpy(), "key": key[0], "in_window": counts, "limited": [n > self.most for n in counts]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, key: str, seconds: int, most: int, delay: str = "1 hour") -> DataFrame:
    """event_id, the key, in_window (counted up to one more than most) and limited of each event of a stream: event_id, ts, key.

    Rejected events count, the window's far edge doesn't. Events of a key are judged in the order of time and id within a batch, and
    batches in the order they come: a late event, within the watermark's delay, is judged by what is still kept
    of those up to its own time, and verdicts given before stay; events without a time are left out, as they have no place in the
    order.
    """
    ship(events.sparkSession)
    # The runner that starts the processor on the driver gets no shipped files, so the class travels by value.
    register_pickle_by_value(sys.modules[__name__])
    kind = events.schema[key].dataType.simpleString()
    timed = events.filter("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select("ts", "event_id", F.col(f"`{key}`").alias("key"), F.unix_micros("ts").alias("at"))
    limited = rows.groupBy("key").transformWithStateInPandas(Limiter(seconds, most), f"event_id long, key {kind}, in_window long, limited boolean", "Append", "EventTime")
    return limited.withColumnRenamed("key", key)
