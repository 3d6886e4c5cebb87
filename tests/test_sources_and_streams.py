import json

import pytest
from pyspark.sql import functions as F

from folioflow.sources import documents, paged, sinks
from folioflow.streaming import delivery, subscribers


def official(slug, **more):
    return {"name": slug, "slug": slug, "dataStatus": "parsed", "transactions": [{"description": "a, \"b\"", "type": "Sale", "date": "2025-01-01"}, {"description": "c"}], "sourceFilings": [{"date": "2025-02-01", "url": f"http://{slug}", "label": None}, {"date": "x"}], **more}


def test_documents(spark, tmp_path):
    for name, value in (("a", official("doe-jan")), ("b", official("old", formerOfficial=True)), ("c", official("new", dataStatus="metadata-only"))):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))
    (tmp_path / "broken.json").write_text("{ not json")
    docs = documents.officials(spark, str(tmp_path))
    assert docs.count() == 3 and documents.roster(docs).count() == 1
    assert documents.official(docs, "jan-doe").first().slug == "doe-jan" and documents.official(docs, "no-body").count() == 0
    assert documents.transactions(docs).filter("row_index = 1").count() == 3
    state = tmp_path / "state"
    state.mkdir()
    (state / "s.json").write_text(json.dumps({"knownFilingUrls": ["http://k"], "knownFilings": {"http://m": 1, "Name": 2}, "newFilings": [{"pdfUrl": "http://n"}]}))
    last = documents.read_json(spark, str(state), documents.LAST_CHECK)
    assert sorted(r.url for r in documents.known_urls(docs, last).collect()) == ["http://doe-jan", "http://k", "http://m", "http://n", "http://new", "http://old"]
    assert documents.read_json(spark, str(tmp_path / "none"), documents.NEWS, optional=True).count() == 0


def test_log_entries(spark, tmp_path):
    for name, value in (("2025-01-01", {"date": "2025-01-01", "items": [{"slug": "a", "newCount": 2}]}), ("2025-01-02", {"date": "2025-01-02", "items": []})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    entries = documents.log_entries(spark, str(tmp_path))
    assert entries.count() == 1 and documents.log_entry(entries, "2025-01-01").count() == 1 and documents.log_entry(entries, "../x").count() == 0


def test_readers_in_order_and_by_official(spark, tmp_path):
    def put(name, value):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(value) if not isinstance(value, str) else value)

    put("news.json", [{"official": "a", "date": "2025-01-02", "url": "u1"}, {"official": "b", "date": "2025-03-01", "url": "u2"}, {"official": "a", "date": "2025-02-01T10:00:00Z", "url": "u3"}, {"official": "a", "date": "soon", "url": "u4"}])
    assert [r.url for r in documents.news(spark, f"{tmp_path}/news.json").collect()] == ["u2", "u3", "u1", "u4"]
    assert [r.url for r in documents.news(spark, f"{tmp_path}/news.json", "a").collect()] == ["u3", "u1", "u4"]
    assert documents.fee_payments(spark, f"{tmp_path}/fees.json").count() == 0
    put("fees.json", {"generated": "x", "payments": [{"officialSlug": "a", "outcome": "paid"}, {"officialSlug": "b", "outcome": "waived"}]})
    assert [r.outcome for r in documents.fee_payments(spark, f"{tmp_path}/fees.json", "b").collect()] == ["waived"]
    put("docs/doe-jan.json", {"official": "x", "documents": [{"kind": "k1"}, {"kind": "k2"}]})
    put("docs/broken.json", "{ not")
    assert [(r.slug, r.ordinal, r.kind) for r in documents.source_documents(spark, f"{tmp_path}/docs", "doe-jan").orderBy("ordinal").collect()] == [("doe-jan", 0, "k1"), ("doe-jan", 1, "k2")]
    assert documents.source_documents(spark, f"{tmp_path}/docs", "none").count() == 0
    put("holdings/a.json", [{"description": "h1", "incomeAmt": {"bucket": "b"}}, {"description": "h2"}])
    put("holdings/b.json", [{"description": "h3"}])
    assert sorted(r.description for r in documents.holdings(spark, f"{tmp_path}/holdings", "a").collect()) == ["h1", "h2"] and documents.holdings(spark, f"{tmp_path}/holdings").count() == 3
    put("divest/a.json", {"confirmedDate": "2025-01-01", "promises": [{"entity": "E", "matchedSaleTickers": ["T"]}]})
    assert [(r.slug, r.confirmedDate, r.entity) for r in documents.divestitures(spark, f"{tmp_path}/divest").collect()] == [("a", "2025-01-01", "E")]
    put("parsed/p.json", {"model": "m", "transactions": [{"description": "d", "confidence": 0.5}]})
    put("parsed/q.json", "nothing")
    assert [(r.file, r.row_index, r.confidence) for r in documents.parsed_filings(spark, f"{tmp_path}/parsed").collect()] == [("p.json", 0, 0.5)]
    for day, n in (("2025-01-01", 2), ("2025-01-03", None), ("2025-01-02", 0)):
        put(f"log/{day}.json", {"date": day, "items": [{"slug": "a", "newCount": n}, {"slug": "b", "newCount": 1}]})
    put("log/bad.json", "[")
    assert [(r.date, r.officialCount, r.tradeCount) for r in documents.updates(spark, f"{tmp_path}/log").collect()] == [("2025-01-03", 2, 1), ("2025-01-02", 2, 1), ("2025-01-01", 2, 3)]


def test_exports(spark, tmp_path):
    sale = {"description": "x, y", "type": "Sale (Full)", "amount": "$1,001-$15,000", "lateFilingFlag": True}
    for slug, rows in (("a", [sale, {**sale, "type": "Purchase", "amount": "Over $1,000,000", "lateFilingFlag": None}]), ("b", None)):
        (tmp_path / f"{slug}.json").write_text(json.dumps({"name": slug.upper(), "slug": slug, "title": "T", "agency": "A", "level": "I", "mostRecentFilingDate": "2025-05-01", "transactions": rows}))
    docs = documents.officials(spark, str(tmp_path))
    sinks.officials_csv(documents.summary(docs), f"{tmp_path}/summary")
    back = spark.read.options(header=True).csv(f"{tmp_path}/summary")
    assert tuple(back.columns) == sinks.SUMMARY and len(sinks.SUMMARY) == 13
    got = {r["slug"]: r for r in back.collect()}
    assert [got["a"][c] for c in sinks.SUMMARY[7:]] == ["2", "1", "1", "1", "8000", "2025-05-01"] and got["b"]["transaction_count"] == "0" and got["a"]["departed_date"] is None
    nested = documents.dataset(docs)
    assert sinks.write_dataset(nested, f"{tmp_path}/full", "one") == "one" == sinks.write_dataset(nested, f"{tmp_path}/full", "two")
    totals = spark.read.json(f"{tmp_path}/full/totals").first()
    assert (totals.officialCount, totals.transactionCount) == (2, 2)
    rows = {r.slug: r for r in spark.read.json(f"{tmp_path}/full/rows").collect()}
    assert rows["a"].transactionCount == 2 and rows["a"].transactions[0].description == "x, y"


def test_stamp_after_an_interrupted_write(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    assert sinks.write_stamped(spark.range(3), path, "one") == "one"
    bad = spark.range(4).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    monkeypatch.setattr(sinks, "content_hash", lambda df: "x")
    with pytest.raises(Exception, match="lost"):
        sinks.write_stamped(bad, path, "two")
    monkeypatch.undo()
    assert sinks.write_stamped(spark.range(3), path, "three") == "three"


def test_reload(spark, tmp_path):
    path = str(tmp_path / "db")
    tables = {"officials": spark.range(3), "transactions": spark.range(5)}
    assert sinks.reload_tables(tables, path) == {"officials": 3, "transactions": 5}
    bad = spark.range(2).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.reload_tables({"officials": spark.range(9), "transactions": bad}, path)
    assert sinks.loaded(spark, path, "officials").count() == 3
    sinks.reload_tables({"officials": spark.range(1), "transactions": spark.range(2)}, path)
    assert sinks.loaded(spark, path, "officials").count() == 1 and sinks.loaded(spark, path, "transactions").count() == 2


def test_appends_of_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(None, "x"), (1, None), (None, None)], "id long, name string")
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "n"), ["id", "name"])
    assert spark.read.parquet(str(tmp_path / "n")).count() == 3


def test_a_send_is_taken_up_again(spark, tmp_path):
    path, ledger, sends = (str(tmp_path / x) for x in ("run", "ledger", "sends"))
    filings = spark.createDataFrame([("u1",), ("u2",)], "url string")
    frozen = delivery.freeze(spark.range(250).withColumn("email", F.concat(F.lit("e"), "id")), path)
    assert delivery.freeze(spark.range(9).withColumn("email", F.lit("other")), path).count() == 250 == frozen.count()
    result = lambda *rows: spark.createDataFrame(rows, "chunk long, ok boolean, error string")
    delivery.record(result((0, True, None), (1, False, "down"), (2, True, None)), path)
    assert delivery.finalise(spark, path, filings, ledger, sends, "r1") == "failed" and not sinks.exists(spark, ledger)
    left = delivery.to_send(spark, path)
    assert left.count() == 100 and left.select("chunk").distinct().first().chunk == 1
    delivery.record(result((1, True, None)), path)
    assert sorted((r.chunk, r.attempt) for r in delivery.tries(spark, path).collect()) == [(0, 1), (1, 1), (1, 2), (2, 1)]
    for _ in range(2):
        assert delivery.finalise(spark, path, filings, ledger, sends, "r1") == "sent"
    assert spark.read.parquet(ledger).count() == 2 and spark.read.parquet(sends).count() == 250


def test_paged_source(spark, tmp_path):
    rows = [{"name": f"n{k}", "level": "Level I"} for k in range(5)]
    (tmp_path / "0-1").write_text(json.dumps({"recordsTotal": 5, "data": rows[:1]}))
    for at in (0, 2, 4):
        (tmp_path / f"{at}-{min(2, 5 - at)}").write_text(json.dumps({"data": rows[at : at + 2]}))
    paged.register(spark)
    load = lambda folder: spark.read.format("paged_records").options(url=f"file://{folder}/{{start}}-{{count}}", pagesize=2, attempts=1, wait=0, delay=0).load()
    assert sorted(r.name for r in load(tmp_path).collect()) == [f"n{k}" for k in range(5)]
    (tmp_path / "2-2").write_text(json.dumps({"data": []}))
    with pytest.raises(Exception, match="before the declared end"):
        load(tmp_path).collect()


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a, \"b\"", None, True), ("plain", "T", False)], "description string, ticker string, late boolean")
    sinks.transactions_csv(rows, str(tmp_path / "t"))
    back = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "t"))
    assert sorted((r.description, r.ticker, r.late_filing) for r in back.collect()) == [("a, \"b\"", None, "yes"), ("plain", "T", "no")]
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert '"a, ""b"""' in text and "\nplain,T" in text


def test_stamp_is_kept_while_rows_are_equal(spark, tmp_path):
    path = str(tmp_path / "s")
    assert sinks.write_stamped(spark.range(3), path, "one") == "one"
    assert sinks.write_stamped(spark.range(3).orderBy(F.desc("id")), path, "two") == "one"
    assert sinks.write_stamped(spark.range(4), path, "three") == "three"


def test_appends_and_dates(spark, tmp_path):
    path = str(tmp_path / "l")
    write = subscribers.ledger_writer(path, "id")
    write(spark.range(3), 0)
    write(spark.range(3), 0)
    write(spark.range(2, 5), 1)
    assert spark.read.parquet(path).count() == 5
    dated = str(tmp_path / "d")
    sinks.write_dated(spark.createDataFrame([("2025-01-01", 1), ("2025-01-02", 2)], "date string, v int"), dated)
    sinks.write_dated(spark.createDataFrame([("2025-01-02", 3)], "date string, v int"), dated)
    assert sinks.write_dated(spark.createDataFrame([("2025-01-02", 9)], "date string, v int"), dated, dry_run=True) == 1
    assert sorted(r.v for r in spark.read.parquet(dated).collect()) == [1, 3]


EVENTS = "event_id long, user_id long, ts timestamp, action string"


def events(spark, *rows):
    base = 1_700_000_000
    data = [(k, u, base + s, a) for k, (u, s, a) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, user_id long, s long, action string").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), "action")


STORY = (
    [(1, s, a) for s, a in ((0, "signup"), (10, "confirm"), (20, "bounce"), (5000, "signup"))]
    + [(2, s, a) for s, a in ((0, "signup"), (5, "unsubscribe"), (100, "signup"), (2000, "signup"), (2001, "confirm"))]
    + [(3, 0, "confirm"), (4, 0, "signup"), (4, 1, "complaint"), (4, 2, "confirm"), (4, 3, "signup")]
)
WANT = {1: ("suppressed", "bounce", 1), 2: ("active", "", 2), 3: ("none", "", 0), 4: ("pending", "", 1)}


def test_lifecycle(spark):
    got = subscribers.lifecycle(events(spark, *STORY), "user_id").collect()
    assert {r.user_id: (r.status, r.reason, r.sends) for r in got} == WANT


def test_lifecycle_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    all_events = events(spark, *STORY)
    source = str(tmp_path / "in")
    for low in (0, 4, 9):
        all_events.filter(F.col("event_id").between(low, {0: 3, 4: 8, 9: 99}[low])).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = subscribers.lifecycle_stream(stream).writeStream.format("memory").queryName("life").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r.user_id: (r.status, r.reason, r.sends) for r in spark.table("life").collect()}
    assert last == WANT


def test_rate_limit(spark):
    rows = [(1, 60 * k, "x") for k in range(9)] + [(2, 0, "x"), (2, 600, "x"), (3, 0, "x"), (3, 0, "x")]
    got = subscribers.rate_limited(events(spark, *rows), "user_id", 600, 8).orderBy("event_id").collect()
    assert [r.limited for r in got] == [False] * 8 + [True] + [False] * 4
    assert [r.in_window for r in got[9:]] == [1, 1, 1, 2]


def test_new_records_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark, (1, 0, "a"), (1, 1, "a"), (1, 2, "b")).write.parquet(source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    known = spark.createDataFrame([("b",)], "action string")
    query = subscribers.new_records(stream, known, "action").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.action for r in spark.table("fresh").collect()] == ["a"]
