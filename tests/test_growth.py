"""Work that grows with its input and no faster, and plans that a larger input doesn't outgrow."""

import datetime as dt
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow import session
from folioflow.functions import brackets, classify
from folioflow.operators import reports as operators
from folioflow.plans import registry, reports
from folioflow.plans.model import all_transactions, transactions
from folioflow.session import checkpoint_dir
from folioflow.streaming import amendments

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def _seconds(df):
    began = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - began


def test_snippet_of_a_long_text_costs_little_more_than_its_remark(spark):
    text = F.concat(F.repeat(F.lit("Ontiontion as thatndou the antiing. "), 150_000), F.lit("of a Filer paid late in"), F.lit("\n"), F.lit("end"))
    df = spark.range(1).select(text.alias("text")).localCheckpoint()
    plain = df.select(classify.has_remark(F.col("text")))
    snippets = df.select(classify.fee_snippet(F.col("text")).alias("snippet"))
    _seconds(plain)
    alone = min(_seconds(plain) for _ in range(2))
    assert min(_seconds(snippets) for _ in range(2)) < 8 * alone + 0.5
    assert snippets.first().snippet == ("Ontiontion as thatndou the antiing. " * 3)[-80 + len("of a ") :] + "of a Filer paid late in"


def test_snippets_among_many_remarks(spark):
    random.seed(3)
    pieces = ["Filer  paid", "paid late", "filing\nextension", "\n", "\r", "x" * 37, "y" * 79, "z" * 80, " ", "é\U0001f600" * 9, "filer", "paid", "late"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.snippet for r in df.select("id", classify.fee_snippet(F.col("text")).alias("snippet")).collect()}
    line = "[^\\n\\r  ]{0,80}"
    found = [re.search(f"{line}(?:filer\\s+paid|paid\\s+late|filing\\s+extension){line}", t, re.I) for t in texts]
    assert got == {k: re.sub("\\s+", " ", m[0]).strip(" ") if m else None for k, m in enumerate(found)}
    assert sum(m is not None for m in found) > 100


def _of_plan(df, node):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(node, line)]


def test_words_of_pages_are_not_shuffled_by_themselves(spark, tmp_path):
    texts = [(1, "a b  c " * 900), (1, "other words"), (2, None), (3, ""), (4, " x"), (None, "n")]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["x43_columns"](spark, str(tmp_path))
    assert len(_of_plan(df, r"Exchange hashpartitioning")) == 1
    got = {(r.doc_id, r.page, r.y): tuple(r)[3:] for r in df.collect()}
    want = {}
    for doc, text in texts:
        for k, word in enumerate(w for w in (text or "").split(" ") if w):
            x, y = k % 12 * 45 + k % 7 * 0.5, round((k % 720 // 12 * 3 + k % 5 * 0.5 - 1) / 3) * 3
            for n, (_, low, high) in enumerate(reports.COLUMNS):
                if low <= x < high:
                    want.setdefault((doc, k // 720, y), [[], [], [], []])[n].append((x, word))
    assert got == {key: tuple(" ".join(w for _, w in sorted(c)) for c in row) for key, row in want.items()}


@needs_data
def test_amended_stream_comes_as_many_files_in_three_batches(spark, monkeypatch):
    batches = []
    amend = amendments.amend
    monkeypatch.setattr(amendments, "amend", lambda batch, *more: (batches.append(more), amend(batch, *more)))
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.glob("amended-*"))
    assert registry.QUERIES["r9_amended_stream"](spark, DATA).count() > 0
    (folder,) = set(root.glob("amended-*")) - before
    assert len(batches) == 3 and len([*folder.glob("filed/**/*.parquet")]) > 3


@needs_data
def test_lines_are_not_shuffled_by_official(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The topmost join is the last one: of lines with parts, where all are of the roster already.
        joins = _of_plan(transactions(spark, DATA), "SortMergeJoin")
        assert "l_partkey" in joins[0] and any("o_custkey" in j for j in joins[1:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@needs_data
def test_golden_rows_and_keys_are_shuffled_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not _of_plan(registry.QUERIES["j13_x46_golden_all"](spark, DATA), "LeftSemi")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_needles_are_in_whatever_the_patterns_fit(spark):
    random.seed(5)
    forms = "bitcoin|muni|municipal fund|due 2030|due may 3|4.5 % x due|rev|g.o.|go|g.o|go.|gen oblig|perp|tier|pfd|etf|index fund|dodge & cox|tax-free|tax free|tax  fund|income fund|fund x class b|marina|llc property|401k|ira|l.p.|lp|lp.|l.p|llp|master fund|n.v.|nv|n.v|nv.|company|companies|com|class a|inc|labs|x|income|due|5%".split("|")
    texts = [*forms, *(random.choice((" ", "-", "\n", "")).join(random.choices(forms, k=3)).title() for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", classify.asset_class(F.col("text"), F.lit(False)).alias("kind"))
    fit = lambda t: next((name for name, patterns in classify.ASSET_PATTERNS if any(re.search(p, t.lower(), re.A) for p in patterns)), "Other")
    assert {r.text: r.kind for r in df.collect()} == {t: fit(t) for t in texts}
    assert "Contains" in df._jdf.queryExecution().optimizedPlan().toString() or "contains(" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_of_holdings_one_pattern_alone_is_sought_twice(spark):
    df = operators.holdings(spark.createDataFrame([(1, "1 x")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\([^,]*, \(\?s\)", plan)) == 1


def test_white_space_at_ends_and_first_matches(spark):
    texts = [f"1 a{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000 and c != 10] + ["1 a \t\x85 ", "1 a b "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", operators.item_lines(F.col("text")).alias("got"), F.regexp_replace("text", r"(?U)\s+$", "").alias("want")).collect()
    assert [r.got for r in rows] == [[r.want] for r in rows]
    random.seed(7)
    pieces = ["$1,001 - $15,000", "$15,001 - $50,000", "Over $50,000,000", "Over", "None (or less than $1,001)", "None (or less than $201)", "$1", "$", ",001", " - ", "No", "None", "\U0001f600", " ", "N/A", "Yes"]
    df = spark.createDataFrame([("".join(random.choices(pieces, k=random.randrange(9))),) for _ in range(500)] + [(None,)], "text string")
    for pattern, begins, alone in ((operators.VALUE, "$NO", True), (operators.INCOME, "$NO", True), (operators.DOLLARS, "$", True), (operators.FLAG, "NYS", False)):
        for r in operators.peeled(df.withColumn("__rest", F.col("text")), "found", pattern, begins, alone=alone).collect():
            m = re.search(pattern, r.text or "", re.A)
            assert (r.found, r["__rest"]) == ((m[0], r.text[: m.start()] + " " + r.text[m.end() :]) if m else (None, r.text)), r


@needs_data
def test_larger_tables_are_joined_in_more_tasks(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = transactions(spark, DATA)
        assert not _of_plan(whole, "_orderkey.*REPARTITION_BY_NUM")
        size = whole.sparkSession.read.parquet(f"{DATA}/lineitem.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        monkeypatch.setattr(session, "PIECE_BYTES", -(-size // 23))
        dealt = transactions(spark, DATA)
        exchanges = _of_plan(dealt, "Exchange hashpartitioning.*_orderkey")
        assert len(exchanges) == 2 and all(re.search(r"_orderkey#\d+L?, 23\), REPARTITION_BY_NUM", line) for line in exchanges)
        assert whole.exceptAll(dealt).count() == 0 and whole.count() == dealt.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@needs_data
def test_lines_are_shuffled_without_what_can_be_worked_out_before(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["v1_v8_errors"](spark, DATA)._jdf.queryExecution()
        shown = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        columns = [set(re.findall(r"(\w+)#", c)) for c in re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", shown)]
        of_lines = [c for c in columns if "l_partkey" in c]
        wide = {"l_extendedprice", "l_quantity", "l_shipdate", "o_orderdate"}
        assert len(of_lines) == 2 and not any(c & wide for c in columns)
        assert "late" in of_lines[0] | of_lines[1] and not any({"late", "ordered"} <= c for c in columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_amounts_of_odd_lines_by_the_place_of_their_bracket(spark, tmp_path):
    bounds = [b[1] + d for b in brackets.BRACKETS for d in (-1.0, -0.5, 0.0)]
    values = [*bounds, None, float("nan"), float("inf"), float("-inf"), -1e9, 0.0]
    day = dt.datetime(2001, 2, 3, 23, 59)
    lines = [(1, 1, 1, n, q, v, "R", None if n == 5 else day) for v in values for n in (None, 1, 2, 5, 6) for q in (None, 1.0)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
    tables = {
        "lineitem": (lines, kinds),
        "orders": ([(1, 1, dt.datetime(2000, 12, 5))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "part": ([(1, "a", "b", 1)], "p_partkey long, p_name string, p_brand string, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(((r.line, r.amount, r.late, r.date) for r in all_transactions(spark, str(tmp_path)).collect()), key=str)
    closed = [b for b in brackets.BRACKETS if b[0] != brackets.EXPORT_UNKNOWN]

    def amount(n, q, v):
        value = None if q is None or v is None else v * q * (12 if n == 1 else 1)
        at_least = lambda low: value is not None and (value >= low or value != value)
        return brackets.EXPORT_UNKNOWN if n == 6 and at_least(1_000_001) else next((b[0] for b in reversed(closed) if at_least(b[1])), closed[0][0])

    # The 60th day isn't late; a line without a date is neither late nor in time.
    assert got == sorted(((n, amount(n, q, v), None if d is None else False, d and d.date()) for _, _, _, n, q, v, _, d in lines), key=str)
