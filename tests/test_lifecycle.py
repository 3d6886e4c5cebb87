import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.streaming import subscribers
from folioflow.streaming.lifecycle import MOVES, STAY, THROTTLE, composed, steps, then

ACTIONS = ["signup", "signup", "confirm", "unsubscribe", "bounce", "complaint", "other", None]
SCHEMA = "user_id long, at long, event_id long, action string"


def by_hand(rows):
    """Each subscriber's events one after the other."""
    out = {}
    for user, at, _, action in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        status, reason, sent, sends = out.get(user, ("none", "", None, 0))
        dead = status == "suppressed" and reason == "bounce"
        if action == "signup" and not dead and status != "active":
            status, reason = "pending", ""
            if sent is None or at is None or at - sent >= THROTTLE:
                sent, sends = at, sends + 1
        elif action == "confirm" and status == "pending":
            status = "active"
        elif action == "unsubscribe" and status != "none" and not dead:
            status = "unsubscribed"
        elif action in ("bounce", "complaint") and status not in ("unsubscribed", "none"):
            status, reason = "suppressed", action
        out[user] = (status, reason, sent, sends)
    return {user: (status, reason, sends) for user, (status, reason, _, sends) in out.items()}


def found(df, **options):
    events = df.select("user_id", F.timestamp_micros("at").alias("ts"), "event_id", "action")
    rows = subscribers.lifecycle(events, "user_id", **options).collect()
    out = {r["user_id"]: (r["status"], r["reason"], r["sends"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_maps_compose():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7, 100):
        actions = [rng.choice(ACTIONS) for _ in range(n)]
        for state in STAY:
            at = state
            for a in actions:
                at = MOVES.get(a, STAY)[at]
            assert composed(actions)[state] == at


@pytest.mark.parametrize("seed", range(20))
def test_steps_compose(seed):
    rng = random.Random(seed)
    times = np.array(sorted(rng.randint(10, rng.choice([50, 200, 4000])) * THROTTLE // 20 for _ in range(60)), dtype=np.int64)
    cuts = sorted(rng.sample(range(61), 3))
    whole = steps(times[:0])
    for part in np.split(times, cuts):
        whole = then(whole, steps(part))
    for before in (None, -THROTTLE, *(rng.randint(-20, 10) * THROTTLE // 20 for _ in range(20))):
        last, sends = before, 0
        for t in times.tolist():
            if last is None or t - last >= THROTTLE:
                last, sends = t, sends + 1
        at = 0 if before is None else int(np.searchsorted(whole[0], before + THROTTLE))
        assert (last, sends) == ((whole[1][at], whole[2][at]) if at < len(whole[0]) else (before, 0))


@pytest.mark.parametrize("seed", range(3))
def test_one_subscriber_over_many_slices(spark, seed):
    """Most events are of two subscribers, so their runs go on over several slices; others begin and end in them."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 1, 1, 1, 5, 5, 5, *range(10, 40)]), rng.choice([None, *([rng.randrange(300) * THROTTLE // 7] * 9)]), k, rng.choice(ACTIONS)) for k in range(2000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(df, fan=2) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_million_events_of_one_subscriber(spark):
    """Sign-ups each 40 seconds, so that mails depend on each other over all slices."""
    action = F.when(F.col("id") % 1000 == 17, "confirm").when(F.col("id") % 1000 == 500, "unsubscribe").when(F.col("id") % 7 == 0, "other").otherwise("signup")
    df = spark.range(1_000_000).select(F.lit(3).cast("long").alias("user_id"), (F.col("id") * 40_000_000).alias("at"), F.col("id").alias("event_id"), action.alias("action"))
    rows = [(3, k * 40_000_000, k, "confirm" if k % 1000 == 17 else "unsubscribe" if k % 1000 == 500 else "other" if k % 7 == 0 else "signup") for k in range(1_000_000)]
    assert found(df.repartition(5)) == by_hand(rows)


def test_text_keys_and_no_events(spark):
    rows = [("b", 0, 1, "signup"), ("a", 0, 2, "signup"), ("b", 5, 3, "confirm")]
    schema = SCHEMA.replace("user_id long", "user_id string")
    assert found(spark.createDataFrame(rows, schema)) == by_hand(rows)
    assert found(spark.createDataFrame([], schema)) == {}
