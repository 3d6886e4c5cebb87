"""A subscriber's status after all events, by transitions that compose.

What an action does to a status is a map of statuses to statuses, and such maps compose; so events, dealt over the tasks in
the order of subscriber and time, need nothing but their own slice, and a subscriber with a third of all events is many slices. A
first pass gives the composed map of the runs of events at a slice's two ends, for only these can go on in another slice. The
driver composes them, one short row for each slice, and tells each slice the status its first run begins with.

Sign-up mails are throttled: one goes out if the last is THROTTLE_SECONDS old. A run of known statuses has known sign-ups, and what it
does to the time of the last mail is a step function of that time: sign-ups within one throttle period after the first are its steps. A second
pass gives whole runs their result and the others their steps, and steps compose, too, a bounded number of runs at a time.
No task holds more of a subscriber than a slice's sign-ups, or FAN times those of one throttle period.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut, ship

THROTTLE_SECONDS = 15 * 60
THROTTLE = THROTTLE_SECONDS * 1_000_000
#: Runs of one subscriber whose steps are composed in one task.
FAN = 32

#: Status and reason.
STATES = (("none", ""), ("pending", ""), ("active", ""), ("unsubscribed", ""), ("unsubscribed", "complaint"), ("suppressed", "bounce"), ("suppressed", "complaint"))
DEAD = STATES.index(("suppressed", "bounce"))
#: Where a sign-up counts: neither of an active subscriber nor of an address that bounced.
OPEN = frozenset(k for k, (status, _) in enumerate(STATES) if status != "active" and k != DEAD)
STAY = tuple(range(len(STATES)))


def _move(state: int, action: str) -> int:
    status, reason = STATES[state]
    if action == "signup" and state in OPEN:
        return STATES.index(("pending", ""))
    if action == "confirm" and status == "pending":
        return STATES.index(("active", ""))
    if action == "unsubscribe" and status != "none" and state != DEAD:
        return STATES.index(("unsubscribed", reason))
    if action in ("bounce", "complaint") and status not in ("unsubscribed", "none"):
        return STATES.index(("suppressed", action))
    return state


#: Each action as a map of states; other actions leave every state as it is.
MOVES = {action: tuple(_move(state, action) for state in STAY) for action in ("signup", "confirm", "unsubscribe", "bounce", "complaint")}


def composed(actions: list[str | None]) -> np.ndarray:
    """The map of states that a run of actions is, composed in pairs."""
    maps = np.array([MOVES.get(a, STAY) for a in actions] or [STAY], dtype=np.int8)
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        first, then = maps[: len(maps) - len(odd) : 2], maps[1 : len(maps) : 2]
        maps = np.concatenate([np.take_along_axis(then, first, axis=1), odd])
    return maps[0]


# -- throttled mails as step functions of the time of the last one -----------------------

Steps = tuple[np.ndarray, np.ndarray, np.ndarray]


def steps(signups: np.ndarray) -> Steps:
    """For each sign-up that may be a run's first mail: its time, the time of the run's last mail then, and the number of mails.

    A last mail lies before the run, so the first one comes at most one throttle period after the run's first sign-up, or with the next
    sign-up after that.
    """
    follows = np.searchsorted(signups, signups + THROTTLE)
    last, sends = signups.copy(), np.ones(len(signups), dtype=np.int64)
    for i in range(len(signups) - 1, -1, -1):
        j = follows[i]
        if j < len(signups):
            last[i], sends[i] = last[j], sends[j] + 1
    used = int(np.searchsorted(signups, signups[0] + THROTTLE)) + 1 if len(signups) else 0
    return signups[:used], last[:used], sends[:used]


def then(a: Steps, b: Steps) -> Steps:
    """The steps of a run that goes on with another."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    at = np.searchsorted(b[0], a[1] + THROTTLE)
    hit, at = at < len(b[0]), np.minimum(at, len(b[0]) - 1)
    last, sends = np.where(hit, b[1][at], a[1]), a[2] + np.where(hit, b[2][at], 0)
    until = a[0][0] + THROTTLE
    used = int(np.searchsorted(b[0], until)) + 1 if a[0][-1] < until else 0
    return np.concatenate([a[0], b[0][:used]]), np.concatenate([last, b[1][:used]]), np.concatenate([sends, b[2][:used]])


# -- slices ------------------------------------------------------------------------------


class Run:
    """The events of one subscriber in one slice."""

    def __init__(self, key, number: int, state: int, open_ended: bool) -> None:
        self.key, self.number, self.state, self.open_ended = key, number, state, open_ended
        self.sent_at, self.sends, self.signups = None, 0, array("q")

    def take(self, at: int | None, action: str | None) -> None:
        if action == "signup" and self.state in OPEN:
            if at is not None and self.open_ended:
                self.signups.append(at)
            elif at is None or self.sent_at is None or at - self.sent_at >= THROTTLE:
                self.sends, self.sent_at = self.sends + 1, at
        self.state = MOVES.get(action, STAY)[self.state]

    def row(self) -> tuple:
        times, last, sends = steps(np.array(self.signups, dtype=np.int64))
        return self.key, self.number, self.open_ended, self.state, self.sends, times.tolist(), last.tolist(), sends.tolist()


def _ends(kind: str):
    """For mapInArrow: each slice's first and last subscriber and the maps of their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = number = None  # [key, map]
        for batch in batches:
            keys, actions = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            if not keys:
                continue
            number = batch.column(3)[0].as_py()
            first = next((i for i, k in enumerate(keys) if k != keys[0]), len(keys))
            last = len(keys) if first == len(keys) else next(i for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]) + 1
            begun = composed(actions[:first])
            if head is None:
                head = tail = [keys[0], begun]
            elif tail[0] == keys[0]:
                tail[1] = begun[tail[1]]
            else:
                tail = [keys[0], begun]
            if last < len(keys):
                tail = [keys[-1], composed(actions[last:])]
        if head is not None:
            written = ["".join(map(str, m)) for m in (head[1], tail[1])]
            yield pa.RecordBatch.from_pylist([{"slice": number, "head": head[0], "tail": tail[0], "one": head is tail, "head_map": written[0], "tail_map": written[1]}], schema=schema)

    schema = pa.schema([("slice", pa.int32()), ("head", kind), ("tail", kind), ("one", pa.bool_()), ("head_map", pa.string()), ("tail_map", pa.string())])
    return run


def entries(ends: list) -> dict[int, tuple[int, bool, bool, object]]:
    """For each slice the state its first run begins with, whether that run began before, whether its last run goes on, and whose that is."""
    ends, out, before, state = sorted(ends, key=lambda r: r["slice"]), {}, None, 0
    for k, end in enumerate(ends):
        began = before is not None and before["tail"] == end["head"]
        goes_on = k + 1 < len(ends) and ends[k + 1]["head"] == end["tail"]
        entry = state if began else 0
        out[end["slice"]] = (entry, began, goes_on, end["tail"])
        state = int(end["head_map"][entry]) if end["one"] else int(end["tail_map"][0])
        before = end
    return out


def _results(known: dict[int, tuple[int, bool, bool, object]], schema: pa.Schema):
    """For mapInArrow: a row for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for key, at, action, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or key != current.key:
                    state, began, goes_on, tail = known[number]
                    began = began and current is None
                    if current is not None:
                        rows.append(current.row())
                    current = Run(key, number, state if began else 0, began or (goes_on and key == tail))
                current.take(at, action)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)
            rows = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(current.row(), schema, strict=True)], schema=schema)

    return run


def _composed_runs(fan: int):
    """For applyInPandas: one row for the runs of a subscriber in some neighbouring slices."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        whole = (np.array([], dtype=np.int64),) * 3
        for r in rows.itertuples():
            whole = then(whole, tuple(np.array(x, dtype=np.int64) for x in (r.times, r.lasts, r.counts)))
        out = rows.iloc[-1:].copy()
        out["slice"], out["sends"] = out["slice"] // fan, rows["sends"].sum()
        for name, values in zip(("times", "lasts", "counts"), whole, strict=True):
            out[name] = [values.tolist()]
        return out

    return run


def lifecycle(events: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """key, status, reason and sends of each subscriber after all events: key, ts, event_id, action.

    Events of one instant come in the order of their ids; those without a time come first, and a sign-up among them is always
    mailed; unknown actions change nothing; a null key is a subscriber of its own.
    """
    spark = ship(events.sparkSession)
    order = ["key", "at", "event_id", "action"]
    rows = events.select(F.col(f"`{key}`").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "action")
    sliced = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "at", "action", F.spark_partition_id().alias("slice")))
    kind = sliced.schema["key"].dataType.simpleString()
    arrow = spark.createDataFrame([], f"key {kind}").toArrow().schema.field("key").type
    ends = sliced.mapInArrow(_ends(arrow), f"slice int, head {kind}, tail {kind}, one boolean, head_map string, tail_map string").collect()
    known, longs = entries(ends), pa.list_(pa.int64())
    schema = pa.schema([("key", arrow), ("slice", pa.int64()), ("open", pa.bool_()), ("state", pa.int32()), ("sends", pa.int64()), ("times", longs), ("lasts", longs), ("counts", longs)])
    written = f"key {kind}, slice long, open boolean, state int, sends long, times array<long>, lasts array<long>, counts array<long>"
    runs = cut(sliced.mapInArrow(_results(known, schema), written))
    parts, slices = runs.filter("open"), max(known, default=0) + 1
    while slices > 1:
        parts = parts.groupBy("key", F.expr(f"slice div {fan}").alias("__group")).applyInPandas(_composed_runs(fan), written)
        slices = -(-slices // fan)
    done = runs.filter("NOT open").unionByName(parts)
    named = lambda k: F.element_at(F.array(*(F.lit(s[k]) for s in STATES)), F.col("state") + 1)
    sends = F.col("sends") + F.coalesce(F.try_element_at("counts", F.lit(1)), F.lit(0))
    return done.select(F.col("key").alias(key), named(0).alias("status"), named(1).alias("reason"), sends.cast("long").alias("sends"))
