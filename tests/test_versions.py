import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.operators import merging
from folioflow.sources.versions import Change, Conflict, Store, clear
from folioflow.streaming import amendments, delivery

ROWS = "description string, date string, type string, amount string, filing string, line long, part long, supplier long"


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions_of_several_tables(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path)
    assert store.version == 0 and store.read("a", schema="id long").count() == 0
    with pytest.raises(ValueError, match="no table"):
        store.read("a")
    key = F.col("id")
    assert store.publish({"a": Change(spark.range(100), key), "b": Change(spark.range(3).withColumn("name", F.lit("x")), key)}, {"m": 4}) == 1
    old = Store(spark, path)
    store.publish({"a": Change(spark.range(100, 150), key)})
    assert ids(Store(spark, path).read("a")) == list(range(150)) and Store(spark, path).read("b").columns == ["id", "name"]
    assert ids(old.read("a")) == list(range(100)), "a version stays as it was"
    assert Store(spark, path).mark("m") == 4 and Store(spark, path).mark("n") is None
    touched = store.touched("a", spark.range(7, 8), key)
    part = store.read("a", touched)
    assert 7 in ids(part) and part.count() < 150
    store.publish({"a": Change(part.filter("id <> 7"), key, touched)})
    assert ids(Store(spark, path).read("a")) == [k for k in range(150) if k != 7]
    store.publish({"a": Change(spark.range(0), key, None)})
    assert Store(spark, path).read("a").count() == 0


def test_of_two_writers_one_fails(spark, tmp_path):
    path, key = str(tmp_path / "s"), F.col("id")
    Store(spark, path).publish({"a": Change(spark.range(1), key)})
    one, two = Store(spark, path), Store(spark, path)
    one.publish({"a": Change(spark.range(1, 2), key)})
    with pytest.raises(Exception, match=f"{Conflict.__name__}|is there already"):
        two.publish({"a": Change(spark.range(2, 3), key)})
    assert ids(Store(spark, path).read("a")) == [0, 1]


def test_a_failed_task_leaves_the_old_state(spark, tmp_path):
    path, key = str(tmp_path / "s"), F.col("id")
    store = Store(spark, path)
    store.publish({"a": Change(spark.range(10), key), "b": Change(spark.range(5), key)})
    folders = sorted(os.listdir(f"{path}/data"))
    bad = spark.range(0, 1000, 1, 8).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        store.publish({"a": Change(spark.range(50), key), "b": Change(bad, key)}, {"m": 1})
    # A failure in a writing task, after others have written.
    late = spark.range(0, 400, 1, 4).select("id", F.udf(lambda x: 1 // (x - 399), "long")("id").alias("v"))
    with pytest.raises(Exception, match="ZeroDivision|zero"):
        store.publish({"c": Change(late, key)})
    now = Store(spark, path)
    assert now.version == 1 and now.mark("m") is None and ids(now.read("a")) == list(range(10)) and ids(now.read("b")) == list(range(5))
    assert sorted(os.listdir(f"{path}/data")) == folders, "what was written is deleted"
    os.makedirs(f"{path}/data/killed")
    assert clear(path) == 1 and ids(Store(spark, path).read("a")) == list(range(10))


def test_a_send_is_finished_at_once(spark, tmp_path, monkeypatch):
    path, store = str(tmp_path / "run"), str(tmp_path / "store")
    filings = spark.createDataFrame([("u1",), ("u2",), ("u2",), (None,)], "url string")
    delivery.freeze(spark.range(250).withColumn("email", F.lit("e")), path)
    assert delivery.finalise_at_once(spark, path, filings, store, "r1") == "failed" and Store(spark, store).version == 0
    delivery.record(spark.createDataFrame([(0, True, None), (1, True, None), (2, True, None)], "chunk long, ok boolean, error string"), path)
    bad = filings.withColumn("url", F.when(F.col("url") == "u2", F.raise_error(F.lit("lost"))).otherwise(F.col("url")))
    with pytest.raises(Exception, match="lost"):
        delivery.finalise_at_once(spark, path, bad, store, "r1")
    assert Store(spark, store).version == 0, "neither ledger nor sends"
    for _ in range(2):
        assert delivery.finalise_at_once(spark, path, filings, store, "r1") == "sent"
    assert delivery.finalise_at_once(spark, path, filings, store, "r2") == "sent"
    now = Store(spark, store)
    assert now.version == 2 and now.read(delivery.LEDGER).count() == 3
    assert Counter(r["run"] for r in now.read(delivery.SENDS).collect()) == {"r1": 250, "r2": 250}


def lots(seed, filings, lines):
    rng = random.Random(seed)
    rows = []
    for f in filings:
        for line in range(lines):
            name = rng.choice(["Alpha ", "alpha", "Beta", "Gamma", None])
            rows.append((name, rng.choice(["2025-01-01", None]), rng.choice(["Sale", "sale"]), rng.choice(["$1", "$2"]), f, line, 0, 0))
    return rows


def key_of(row):
    name, date, kind, amount = row[:4]
    return "|".join(x for x in (name.strip().lower() if name is not None else None, date, kind.lower(), amount) if x is not None)


def wanted(old, new):
    """How often each key is there in the end: as often as in the filing that has it most, or as it was."""
    have, filed = Counter(map(key_of, old)), Counter((key_of(r), r[4]) for r in new)
    out = dict(have)
    for (key, _), n in filed.items():
        out[key] = max(out.get(key, 0), n)
    return out


def run_stream(spark, tmp_path, source, store, broken=None):
    """One run of the stream; broken: raises before or after the write of a batch."""
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    write = amendments.writer(store)

    def each(batch, batch_id):
        if broken == ("before", batch_id):
            raise RuntimeError("killed")
        write(batch, batch_id)
        if broken == ("after", batch_id):
            raise RuntimeError("killed")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)


def test_killed_and_replayed_batches_give_the_batch_result(spark, tmp_path):
    old, new = lots(1, ["f0"], 12), lots(2, ["f1", "f2", "f3"], 30)
    store, source = str(tmp_path / "s"), str(tmp_path / "in")
    amendments.start(spark.createDataFrame(old, ROWS), store)
    amendments.start(spark.createDataFrame(new, ROWS), store)
    # Filings are split over files in the order of lines, so one filing comes in several batches.
    for k in range(3):
        spark.createDataFrame([r for r in new if r[5] % 3 == k], ROWS).coalesce(1).write.mode("append").parquet(source)
    for broken in (("after", 0), ("before", 1), ("after", 1), None):
        if broken:
            with pytest.raises(Exception, match="killed"):
                run_stream(spark, tmp_path, source, store, broken)
        else:
            run_stream(spark, tmp_path, source, store)
    rows = [tuple(r) for r in amendments.merged(spark, store).collect()]
    assert Counter(map(key_of, rows)) == wanted(old, new)
    assert not Counter(rows) - (Counter(old) + Counter(new)), "only rows that were filed, none more often than filed"
    whole = merging.multiset_targets(spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS)).collect()
    assert {r["key"]: r["target"] for r in whole} == wanted(old, new)
    version = Store(spark, store).version
    assert amendments.amend(spark.createDataFrame(new, ROWS), 2, store) == version, "a batch that is known adds nothing"
    assert amendments.amend(spark.createDataFrame([], ROWS), 7, store) == version
