import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioflow.operators import activity, digest, matching, merging, ordering, quality, rollups

D = dt.date.fromisoformat


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def tx(spark, data):
    """Rows (official_id, date, type, amount, late, description, ticker)."""
    full = [(o, f"N{o}", D(d), t, a, late, text, tick, k, 1, 1, 1) for k, (o, d, t, a, late, text, tick) in enumerate(data)]
    return spark.createDataFrame(full, "official_id long, official string, date date, type string, amount string, late boolean, description string, ticker string, filing long, line int, part long, supplier long")


SMALL = "$1,001-$15,000"


def test_as_of(spark):
    t = tx(spark, [(1, d, "Sale", SMALL, False, "x", None) for d in ("2020-01-01", "2020-02-01", "2020-02-02", "2020-09-01")] + [(2, "2020-01-01", "Sale", SMALL, False, "x", None)])
    filings = [(1, D("2020-02-01"), 10, "u", None), (1, D("2020-02-01"), 5, "u", None), (1, D("2020-03-01"), 11, None, "l"), (1, D("2020-02-02"), 1, None, ""), (1, D("2020-12-01"), 2, None, None)]
    got = matching.as_of(t, spark.createDataFrame(filings, "official_id long, date date, ordinal long, url string, label string"), "official_id")
    assert rows(got.filter("official_id = 1"), "date", "filing_ordinal") == [(D("2020-01-01"), 5), (D("2020-02-01"), 5), (D("2020-02-02"), 11), (D("2020-09-01"), 11)]
    assert got.filter("official_id = 2").first().filing_ordinal is None


def test_as_of_of_one_busy_official(spark):
    """Every row of one official: the answer is found once for each of its days, and dates may be missing."""
    t = spark.range(3000).select(F.lit(1).alias("official_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("date"), "id")
    t = t.unionByName(spark.createDataFrame([(1, None, 9000), (None, D("2020-01-01"), 9001)], "official_id int, date date, id long"))
    f = spark.range(50).select(F.lit(1).alias("official_id"), F.date_add(F.lit("2020-01-05").cast("date"), (F.col("id") * 7).cast("int")).alias("date"), F.col("id").alias("ordinal"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("label"))
    got = {r.id: r.filing_ordinal for r in matching.as_of(t, f, "official_id").collect()}
    assert len(got) == 3002 and got[9000] == 49 and got[9001] is None
    assert all(got[k] == min(49, max(0, -((4 - k % 400) // 7))) for k in range(3000))


def test_texts_with_tokens(spark):
    texts = ["Green Hill Partners", "greenhill", "a b", "", None, "x", "blue green"]
    needles = [(1, ["GREEN"]), (2, ["hill", "green"]), (3, ["a"]), (4, ["zz", "green"]), (5, []), (6, [""]), (7, ["b", "e"]), (8, ["nothing"])]
    got = matching.texts_with_tokens(spark.createDataFrame([(t,) for t in texts], "description string"), spark.createDataFrame(needles, "needle_id int, tokens array<string>"))
    want = {(t, n) for t in texts if t for n, tokens in needles if any(tokens) and all(x.lower() in t.lower() for x in tokens)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_numbered(spark):
    df = spark.createDataFrame([(k % 3, k % 2, k) for k in range(60)] + [(None, 0, 100)], "a int, b int, c int")
    got = ordering.numbered(df, {"a": False, "b": True}, [F.asc("c")], "place").collect()
    order = sorted(got, key=lambda r: (r.a is None, -(r.a or 0), r.b, r.c))
    assert [r.place for r in order] == list(range(1, 62)) and len(got[0]) == 4


def test_golden_accuracy_and_pins(spark):
    scored = spark.createDataFrame([("a", True, 2), ("a", True, 2), ("b", False, 0), ("b", True, 1)], "g string, present boolean, agreeing long")
    counts = spark.createDataFrame([("a", 2), ("b", 9)], "g string, n long")
    assert rows(matching.golden_accuracy(scored, counts, "g", 2), "g", "accuracy", "passed", "count_differs") == [("a", 100.0, True, False), ("b", 25.0, False, True)]
    counted = spark.createDataFrame([(5, 0)], "n int, failures int")
    golden = matching.golden_accuracy(scored, counts, "g", 2)
    assert quality.verdict(counted, golden).first().verdict == "FAIL" and quality.verdict(counted, golden.filter("passed")).first().verdict == "PASS"
    assert quality.verdict(counted, golden.limit(0)).first().verdict == "PASS"
    pins = quality.pinned({"x": spark.range(3).agg(F.count("*").alias("n")), "y": spark.range(4).agg(F.count("*").alias("n"))}, {"x": 3, "y": 3})
    assert rows(pins, "name", "holds") == [("x", True), ("y", False)]
    assert quality.assert_pinned(pins.filter("name = 'x'")).count() == 1
    with pytest.raises(Exception, match="count of y is 4, pinned to 3"):
        quality.assert_pinned(pins).collect()


def test_send_keys(spark):
    import hashlib

    pending = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "url string")
    got = digest.send_key(pending).first()
    assert (got.send_key, got.urls) == (hashlib.sha256(b"a\nb").hexdigest(), 2)
    with pytest.raises(Exception, match="more than 1 urls"):
        digest.send_key(pending, most=1).collect()


def test_first_texts(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (5, None), (7, ""), (8, "y"), (8, "y")], "id int, t string")
    assert sorted(map(str, merging.keep_first_text(df, "t", "id").collect())) == sorted(map(str, df.groupBy("t").agg(F.min("id").alias("id")).collect()))


def lots(spark, *counts):
    data = [(f, k, k, k, key, D("2020-01-01"), "Sale", SMALL) for f, key, n in counts for k in range(n)]
    return spark.createDataFrame(data, "filing long, line int, part long, supplier long, description string, date date, type string, amount string")


def test_multiset_merge(spark):
    added = lambda old, new: merging.multiset_merge(old, new).count()
    assert added(lots(spark, (0, "k", 1)), lots(spark, (1, "k", 2), (2, " K ", 3))) == 2
    assert added(lots(spark, (0, "k", 2)), lots(spark, (1, "k", 2))) == 0
    assert added(lots(spark, (0, "z", 2)), lots(spark, (1, "k", 2))) == 2
    targets = merging.multiset_targets(lots(spark, (0, "k", 4)), lots(spark, (1, "k", 2), (2, "m", 3)))
    assert rows(targets, "target", "added") == [(3, 3), (4, 0)]


def test_keep_one_and_sets(spark):
    all_rows = lots(spark, (1, "a", 2), (2, "a", 1))
    assert merging.keep_one(all_rows, ["description"], [F.desc("filing"), F.asc("line")]).first().filing == 2
    assert merging.set_merge(lots(spark, (0, "b", 1)), all_rows).count() == 1


def test_reconcile(spark):
    held = spark.createDataFrame([("A", "Alpha", 1, 10), ("A", "Alpha two", 2, 5), ("B", "Beta", 3, 1), ("X", "Fund", 4, 1), (None, "n", 5, 1)], "ticker string, description string, ordinal int, value long")
    sold = spark.createDataFrame([("A",), ("C",), ("C",), ("X",), ("",)], "ticker string")
    got = matching.reconcile(held, sold, ("X",))
    assert rows(got, "ticker", "status", "sales", "entry_value", "description") == [("A", "sold", 1, 15, "Alpha"), ("B", "no-sale-on-file", 0, 1, "Beta"), ("C", "sold", 2, 0, "Sold (C)"), ("X", "exempt", 1, 1, "Fund")]


def test_promises(spark):
    sales = tx(spark, [(1, "2020-05-01", "Sale", SMALL, False, "Green Hill Partners", None), (1, "2020-06-01", "Sale", SMALL, False, "other", "T"), (1, "2019-01-01", "Sale", SMALL, False, "other", "T")])
    promises = [(1, D("2020-01-01"), ["T"], []), (2, D("2020-01-01"), [], ["green", "PARTNERS"]), (3, D("2020-01-01"), [], ["green", "blue"]), (4, D("2020-01-01"), [], []), (5, D("2020-01-01"), ["T"], ["other"])]
    got = matching.promise_evidence(spark.createDataFrame(promises, "promise_id int, confirmed date, tickers array<string>, tokens array<string>"), sales, ["filing"])
    assert rows(got, "promise_id", "sales") == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 1)]


def test_cadence(spark):
    dates = {1: ["2025-03-01", "2025-03-05", "2025-03-11"], 2: ["2025-03-01", "2025-03-02", "2025-03-04", "2025-03-07", "2025-03-11", "2025-03-11"], 3: ["2020-01-01"] * 9}
    filings = spark.createDataFrame([(k, D(d)) for k, v in dates.items() for d in v], "official_id int, date date")
    got = activity.cadence(filings, "official_id", "2025-03-20", "2025-02-01").collect()
    assert [(r.official_id, r.filings, r.median_gap, r.projected, r.days_past) for r in got] == [(2, 5, 3, D("2025-03-14"), 6)]


def test_month_axis(spark):
    t = tx(spark, [(1, "2024-12-31", "Sale", SMALL, False, "x", None), (1, "2025-03-05", "Exchange", SMALL, True, "x", None)])
    assert rows(activity.by_month(t, "2025-01-01"), "month", "sales", "purchases") == [(D("2025-01-01"), 0, 0), (D("2025-02-01"), 0, 0), (D("2025-03-01"), 0, 1)]
    assert activity.by_month(t, "2030-01-01").count() == 1
    assert activity.peak(activity.by_month(t, "2025-01-01")).first().peak == 1
    per = activity.series_by_month(t, "official_id")
    assert per.count() == 4 and per.agg(F.sum("purchases"), F.sum("total")).first()[0:2] == (0, 2)


def test_late(spark):
    t = tx(spark, [(1, "2025-01-01", "Sale", SMALL, True, "x", None), (2, "2025-01-01", "Sale", SMALL, True, "x", None), (2, "2025-01-01", "Purchase", SMALL, False, "x", None), (3, "2025-01-01", "Purchase", SMALL, False, "x", None)])
    stats = rollups.late_stats(t)
    assert rows(stats, "official_id", "rate") == [(1, 100.0), (2, 50.0)]
    assert rows(rollups.cohorts(stats), "cohort", "officials") == [("always", 1)]
    assert rollups.headline(t.limit(0), t.limit(0)).first().late_percent == 0
    assert rollups.late_overall(t).first().rate_per_mille == 500


def test_summary_keeps_officials_without_rows(spark):
    roster = spark.createDataFrame([(1, "a"), (2, "b")], "official_id long, official string")
    t = tx(spark, [(1, "2025-01-01", "Sale", "Over $1,000,000", False, "x", None)])
    assert rows(rollups.official_summary(roster, t), "official_id", "n", "value") == [(1, 1, 0), (2, 0, 0)]
    sentence = rollups.sentences(rollups.summary_stats(t)).first().sentence
    assert sentence == "N1 reported 1 sale."


def people(spark, *data):
    return spark.createDataFrame(data, "slug string, name string, ingested string, new_count long, posted string, former boolean")


def test_digest(spark):
    who = people(spark, ("a", "A", "2025-05-02", 3, "2025-05-01", False), ("b", "B", "2025-05-02", 0, "2025-05-01", False), ("c", "C", None, 9, "2025-05-01", False), ("d", "D", "2025-05-02", 9, "2025-04-01", False))
    filings = spark.createDataFrame([("a", "u1", "2025-05-01"), ("a", "u2", "2025-04-01"), ("b", "u3", "2025-05-01"), ("c", "u4", "2025-05-01"), ("d", "u5", "2025-05-01"), ("d", None, "2025-05-01")], "slug string, url string, date string")
    ledger = spark.createDataFrame([("u2",), ("u5",)], "url string")
    pending = digest.pending_filings(who, filings, ledger, "2025-05-01")
    assert rows(pending, "url") == [("u1",), ("u3",)]
    cards = digest.items(who, pending)
    assert rows(cards, "slug", "filings", "primary_url", "place") == [("a", 1, "u1", 1)]
    assert rows(digest.also_new(who, cards, "2025-05-16"), "slug", "new_count", "place") == [("b", None, 1), ("d", 9, 2)]
    assert digest.also_new(who, cards, "2025-05-17").count() == 0
    trades = spark.createDataFrame([("a", f"2025-01-0{k}", k) for k in range(1, 9)], "slug string, date string, k int")
    assert rows(digest.trades_shown(cards, trades, [F.asc("k")]), "k") == [(6,), (7,), (8,)]
    assert digest.chunks(spark.range(250)).groupBy("chunk").count().count() == 3


def test_routing(spark):
    followers = spark.createDataFrame([(1, None), (2, None), (3, "A"), (4, "A"), (5, "B")], "id int, slug string")
    slugs = spark.createDataFrame([("A",), ("A",)], "slug string")
    assert matching.routed(followers, slugs).count() == 4
    assert tuple(rollups.follow_breakdown(followers, slugs).first()) == (5, 2, 4, 1)


def test_errors_are_independent(spark):
    good = ("x", "Sale", SMALL, "2024-01-01", True, "ABC")
    bad = [("", *good[1:]), (good[0], "Gift", *good[2:]), (*good[:2], "$5", *good[3:]), (*good[:3], "24-01-01", *good[4:]), (*good[:3], "2024-13-01", *good[4:]), (*good[:3], "2999-01-01", *good[4:]), (*good[:3], "2018-01-01", *good[4:]), (*good[:4], None, "ABC"), (*good[:5], "A1"), (None, None, None, None, None, None)]
    df = spark.createDataFrame([good, *bad], "description string, type string, amount string, date_text string, late boolean, ticker string")
    assert [len(r[0]) for r in df.select(quality.errors("2026-01-01")).collect()] == [0, *[1] * 9, 5]


def test_anomalies(spark):
    t = tx(spark, [(1, "2025-01-01", "Sale", SMALL, True, "x", None)] * 3 + [(2, "2025-01-01", "Sale", SMALL, True, "x", None), (2, "2025-01-02", "Sale", SMALL, True, "x", None)])
    assert rows(quality.anomalies(t, "official_id", ["description", "amount", "type"], 200, 2), "official_id", "duplicates", "one_day") == [(1, 2, True)]


def test_pages(spark):
    ids = lambda n: sorted(r.id for r in ordering.page(spark.range(250), [F.asc("id")], n).collect())
    assert ids("3") == list(range(200, 250)) == ids("99") and ids("x") == list(range(100)) == ids(None)


def test_career_and_merges(spark):
    who = spark.createDataFrame([(1, D("2025-01-10"), None, D("2025-01-04")), (2, D("2025-01-10"), D("2025-01-20"), D("2025-01-01"))], "official_id int, confirmed date, took_office date, agreed date")
    assert rows(matching.career_events(who), "official_id", "event") == [(1, "confirmed"), (1, "deadline"), (2, "agreement"), (2, "confirmed"), (2, "deadline"), (2, "took office")]
    old = spark.createDataFrame([("e", "active", None), ("f", "pending", "x")], "email string, status string, slug string")
    new = spark.createDataFrame([("e", "pending", "y"), ("f", "pending", "y"), ("g", "pending", "y")], "email string, status string, slug string")
    assert {r.email: r.slug for r in merging.upsert_follow(old, new).collect()} == {"e": None, "f": "y", "g": "y"}


def test_send_keys_of_groups(spark):
    import hashlib

    data = [("a", "u2"), ("a", "u1"), ("a", "u2"), (None, "u3"), ("b", None), ("c", "\u00e9")] + [("big", f"{k:05d}") for k in range(20000)]
    got = {r.g: (r.send_key, r.urls) for r in digest.send_keys(spark.createDataFrame(data, "g string, url string"), ["g"]).collect()}
    want = {}
    for g, u in data:
        if u is not None:
            want.setdefault(g, set()).add(u)
    assert got == {g: (hashlib.sha256("\n".join(sorted(us)).encode()).hexdigest(), len(us)) for g, us in want.items()}
    none = digest.send_key(spark.createDataFrame([(None,)], "url string")).first()
    assert (none.send_key, none.urls) == (hashlib.sha256(b"").hexdigest(), 0)


def test_cadence_takes_the_upper_median(spark):
    import random

    rng = random.Random(2)
    dates = {k: sorted({D("2020-01-01") + dt.timedelta(days=rng.randrange(0, 60)) for _ in range(n)}) for k, n in enumerate([0, 1, 3, 4, 5, 6, 9, 20, 40])}
    data = [(k, x) for k, found in dates.items() for x in found] + [(7, dates[7][0])] * 5 + [(3, None), (3, D("2019-01-01"))]
    got = {r.k: (r.filings, r.median_gap, r.last_filing) for r in activity.cadence(spark.createDataFrame(data, "k int, date date"), "k", "2020-06-01", "2020-01-01").collect()}
    want = {}
    for k, found in dates.items():
        gaps = sorted((b - a).days for a, b in zip(found, found[1:], strict=False))
        if len(found) >= 4:
            want[k] = (len(found), gaps[len(gaps) // 2], found[-1])
    assert got == want and len(got) > 4


def test_stored_pages_read_their_slices_alone(spark, tmp_path):
    import shutil

    data = spark.range(0, 5000, 1, 3).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"), "id")
    order = [F.desc("a"), F.asc("b"), F.asc("id")]
    path = str(tmp_path / "p")
    assert ordering.write_paged(data, order, path, slices=8) == 5000
    whole = [r.id for r in data.orderBy(*order).collect()]
    for number, at in ((1, 1), ("3", 3), (50, 50), ("x", 1), (99, 50), (None, 1)):
        rows = ordering.read_page(spark, path, number).orderBy("place").collect()
        assert [r.id for r in rows] == whole[(at - 1) * 100 : at * 100] and {(r.page, r.pages) for r in rows} == {(at, 50)}
        assert [r.place for r in rows] == list(range((at - 1) * 100 + 1, at * 100 + 1))
    slices = sorted((tmp_path / "p" / "rows").glob("__slice=*"))
    assert len(slices) > 2
    for other in slices[1:]:
        shutil.rmtree(other)
    assert [r.id for r in ordering.read_page(spark, path, 1).orderBy("place").collect()] == whole[:100]
    assert ordering.write_paged(data.limit(0), order, str(tmp_path / "none")) == 0


def test_many_needles_against_texts(spark):
    import random

    rng = random.Random(6)
    syllables = ["ba", "Be", "bi", "co", "cu", "da", "x", "\u00c9a", " "]
    texts = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(0, 12))) for _ in range(300)}) + [None]
    needles = [(k, ["".join(rng.choice(syllables).strip() for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 3))]) for k in range(400)]
    got = matching.texts_with_tokens(spark.createDataFrame([(t,) for t in texts], "description string"), spark.createDataFrame(needles, "needle_id int, tokens array<string>"))
    want = {(t, n) for t in texts if t is not None for n, tokens in needles if any(tokens) and all(x.lower() in t.lower() for x in tokens)}
    rows_ = list(map(tuple, got.collect()))
    assert set(rows_) == want and len(rows_) == len(want) > 1000


def test_chunks_of_any_ids(spark):
    """Chunks in plain Python: ids that lie together, far apart, beyond 2^53, null and none at all."""
    near = 2**60
    ids = [None, None, *range(-5, 40), *(k * k * 7919 for k in range(7, 60)), *(near + k for k in range(30))]
    df = spark.createDataFrame([(i, f"r{k}") for k, i in enumerate(ids)], "id long, name string").repartition(3)
    want = sorted(ids, key=lambda i: (i is not None, i or 0))
    for ranges in (2, 16, 2048):
        got = digest.chunks(df, 10, ranges)
        assert got.columns == ["id", "name", "chunk"]
        rows = sorted(((r.id, r.chunk) for r in got.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert rows == [(i, k // 10) for k, i in enumerate(want)]
    assert digest.chunks(df.limit(0)).count() == 0
