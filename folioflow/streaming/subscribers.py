"""Subscribers' events: rate limits, throttles, lifecycle and delivery, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.rollups import n_if
from folioflow.streaming.lifecycle import MOVES, OPEN, STATES, STAY, THROTTLE, lifecycle  # noqa: F401

#: What an event does to a subscriber.
ACTIONS = {"signup": "signup", "click": "confirm", "error": "bounce", "view": "unsubscribe", "purchase": "complaint"}


def rate_limited(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Whether an event is one too many among its key's last seconds; rejected events count, the window's far edge doesn't.

    Events of one instant are counted in the order of their ids.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumn("__at", micros)
    past = Window.partitionBy(key).orderBy("__at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    peers = Window.partitionBy(key, "__at")
    nth = F.row_number().over(peers.orderBy("event_id"))
    in_window = F.count("*").over(past) - (F.count("*").over(peers) - nth)
    return rows.withColumn("in_window", in_window.cast("long")).withColumn("limited", F.col("in_window") > most).drop("__at")


def latest_status(events: DataFrame, key: str, status: str) -> DataFrame:
    """The last event of each key decides."""
    return events.groupBy(key).agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def to_ask_again(signups: DataFrame) -> DataFrame:
    """Active sign-ups that were never asked again and never confirmed: status, asked_again, confirmed."""
    return signups.filter((F.col("status") == "active") & F.col("asked_again").isNull() & F.col("confirmed").isNull())


class Subscriber(StatefulProcessor):
    """The same moves, kept as state of a stream; a row goes out for each batch that changed a subscriber."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("subscriber", "status string, reason string, sent_at long, sends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, reason, sent_at, sends = self.state.get() if self.state.exists() else ("none", "", None, 0)
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        state = STATES.index((status, reason))
        for at, action in zip(events["at"].tolist(), events["action"].tolist(), strict=True):
            if action == "signup" and state in OPEN and (sent_at is None or at - sent_at >= THROTTLE):
                sent_at, sends = at, sends + 1
            state = MOVES.get(action, STAY)[state]
        status, reason = STATES[state]
        self.state.update((status, reason, sent_at, sends))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "reason": [reason], "sends": [sends]})

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """A stream of user_id, status, reason, sends from a stream of user_id, ts, event_id, action."""
    rows = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select("user_id", "at", "event_id", "action")
    return rows.groupBy("user_id").transformWithStateInPandas(Subscriber(), "user_id long, status string, reason string, sends long", "Update", "None")


def new_records(stream: DataFrame, known: DataFrame, key: str, delay: str = "30 days") -> DataFrame:
    """Records of a stream whose key isn't known yet, each once within the watermark's delay."""
    unseen = stream.join(known.select(key), key, "left_anti")
    return unseen.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def ledger_writer(path: str, key: str):
    """A function for foreachBatch that adds to a ledger each key once, also when a batch is run again."""
    from folioflow.sources.sinks import append_new

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, path, [key])

    return write


def limits_summary(limited: DataFrame, key: str) -> DataFrame:
    return limited.groupBy(key).agg(F.count("*").alias("events"), n_if(F.col("limited")).alias("limited"), F.max("in_window").alias("most"))
