import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioflow.functions import brackets, classify, scalars, tokens


def one(spark, column, **values):
    """The column's value on one row of values."""
    kinds = {int: "long", str: "string", bool: "boolean", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("value, shown", [(999, "$999"), (1000, "$1K"), (999_999, "$1000K"), (10**6, "$1.0M"), (1_250_000, "$1.3M"), (10**9, "$1.0B")])
def test_compact_currency(spark, value, shown):
    assert one(spark, scalars.compact_currency(F.col("v")), v=value) == shown


def test_brackets(spark):
    for name, low, mid, label in brackets.BRACKETS:
        got = one(spark, F.struct(brackets.least(F.col("a")).alias("l"), brackets.midpoint(F.col("a")).alias("m"), brackets.midpoint(F.col("a"), "export").alias("e"), brackets.label(F.col("a")).alias("n")), a=name)
        assert (got.l, got.m, got.n) == (low, mid, label)
        assert got.e == (0 if name == brackets.EXPORT_UNKNOWN else mid)
    assert one(spark, brackets.midpoint(F.col("a")), a="?") is None and one(spark, brackets.midpoint(F.col("a"), "export"), a="?") == 0
    assert one(spark, brackets.bracket_of(F.col("v")), v=15_000.0) == "$1,001-$15,000" and one(spark, brackets.bracket_of(F.col("v")), v=15_001.0) == "$15,001-$50,000"


@pytest.mark.parametrize(
    "name, shown, backwards, slug",
    [("Doe, Jan", "Jan Doe", "Jan Doe", "jan-doe"), ("Solo", "Solo", "Solo", "solo"), ("Roe, Kim, Jr.", "Kim Roe", "Jr. Kim Roe", "kim-roe"), ("O'Neil, Zoë", "Zoë O'Neil", "Zoë O'Neil", "zo-o-neil")],
)
def test_names(spark, name, shown, backwards, slug):
    assert one(spark, scalars.display_name(F.col("n")), n=name) == shown
    assert one(spark, scalars.reversed_name(F.col("n")), n=name) == backwards
    assert one(spark, scalars.slug(F.col("n")), n=name) == slug


@pytest.mark.parametrize(
    "role, agency, line",
    [
        ("Secretary of the Navy", "Department of Defense, Department of the Navy", "Secretary of the Navy"),
        ("Administrator", "National Aeronautics and Space Administration", "Administrator · National Aeronautics and Space Administration"),
        ("Director", "Office of the United States", "Director"),
        ("", "Department of Energy", "Department of Energy"),
        ("Deputy", "", "Deputy"),
    ],
)
def test_office_lines(spark, role, agency, line):
    assert one(spark, scalars.office_line(F.col("r"), F.col("a")), r=role, a=agency) == line


def test_office_line_short(spark):
    line = scalars.office_line_short(F.col("r"), F.col("a"))
    assert one(spark, line, r="Administrator", a="National Aeronautics and Space Administration") == "Administrator · NASA"
    assert one(spark, line, r="Director, Office of Science and Technology Policy", a="") == "Director, OSTP"


@pytest.mark.parametrize("text, shown", [("2026-09-04", "Sept. 4, 2026"), ("2026-06-04T10:00:00Z", "June 4, 2026"), ("soon", "Unknown date"), ("2020-13-45", "Unknown date")])
def test_press_dates(spark, text, shown):
    assert one(spark, scalars.press_date(F.col("t")), t=text) == shown


def test_months(spark):
    assert one(spark, scalars.month_key(F.col("t")), t="2025-13-01") == "2025-13" and one(spark, scalars.month_key(F.col("t")), t="25-1") is None
    assert one(spark, scalars.next_month(F.col("t")), t="2025-12") == "2026-01"


@pytest.mark.parametrize("text, fits", [("278 Transaction", True), ("278-T", True), ("278T(2)", True), ("278TERM", False), ("278 Termination", False)])
def test_form_types(spark, text, fits):
    assert one(spark, classify.is_periodic_report(F.col("t")), t=text) is fits


@pytest.mark.parametrize(
    "text, ticker, kind",
    [
        ("Bitcoin trust", False, "Cryptocurrency"),
        ("State REV 5.00% due Oct 1, 2049", False, "Bonds & Fixed Income"),
        ("Big Bank preferred", True, "Preferred Securities"),
        ("Vanguard Total", True, "ETFs & Index Funds"),
        ("Income fund class A", False, "Mutual Funds"),
        ("Lake LLC, rental property", False, "Real Estate"),
        ("éllc holdings", False, "Private Funds & Partnerships"),
        ("Roll-over IRA", False, "Retirement Accounts"),
        ("Acme Inc", False, "Individual Stocks"),
        ("Acme", True, "Individual Stocks"),
        ("Acme", False, "Other"),
    ],
)
def test_asset_classes(spark, text, ticker, kind):
    assert one(spark, classify.asset_class(F.col("t"), F.col("k")), t=text, k=ticker) == kind


#: Texts of each class, by hand, so that a wrong constant shows though the SQL is built from the same tables.
CLASS_EXAMPLES = {
    "Cryptocurrency": "bitcoin|ethereum|crypto|solana|polygon|polkadot",
    "Bonds & Fixed Income": "treasury|muni|municipal|fixed income|bond|x due 2031|due oct 1|5.00% x due|4% due|rev|g.o.|go|gas dist|gas sply|gen oblig|sch dist|anticipation|bond fund|municipal fund",
    "Preferred Securities": "perp|tier|preferred|pfd",
    "ETFs & Index Funds": "etf|index fund|vanguard|ishares|spdr",
    "Mutual Funds": "pimco|franklin|invesco|brandywine|allspring|blackrock|fidelity|schwab|dodge & cox|nuveen|tax-free|tax free|income fund|tax fund|mutual  fund|fund x class b",
    "Real Estate": "real estate|marina|llc x property|llc, land",
    "Retirement Accounts": "retirement|401k|ira",
    "Private Funds & Partnerships": "l.p.|lp|l.p|llc|llp|partners|capital|ventures|associates|master fund|fund|l.p.x",
    "Individual Stocks": "inc|corp|plc|n.v.|nv|ltd|companies|company|com|unsolicited|bancshares|bancorp|labs|technologies|class a",
    "Other": "bitcoins|bondage|duet 5|preferredx|xetf|fundx|_ira|401k2|acme|class d|tax_free|\u00e9|",
}


def test_every_asset_pattern(spark):
    rows = [(text, kind) for kind, texts in CLASS_EXAMPLES.items() for text in texts.split("|")]
    rows += [(f"\u00e9{text.upper()}\u00e9", kind) for text, kind in rows if kind not in ("Other", "Bonds & Fixed Income") and text[:1].isalpha() and text[-1:].isalpha()]
    got = spark.createDataFrame(rows, "text string, kind string").select("text", "kind", classify.asset_class(F.col("text"), F.lit(False)).alias("got")).filter("kind <> got").collect()
    assert got == []


#: By hand, as above: estimates for the site and for exports.
ESTIMATES = (
    ("$1,001-$15,000", 8_000, 8_000), ("$15,001-$50,000", 32_500, 32_500), ("$50,001-$100,000", 75_000, 75_000), ("$100,001-$250,000", 175_000, 175_000), ("$250,001-$500,000", 375_000, 375_000),
    ("$500,001-$1,000,000", 750_000, 750_000), ("$1,000,001-$5,000,000", 3_000_000, 3_000_000), ("$5,000,001-$25,000,000", 15_000_000, 15_000_000), ("$25,000,001-$50,000,000", 37_500_000, 37_500_000),
    ("Over $50,000,000", 75_000_000, 75_000_000), ("Over $1,000,000", 1_500_000, 0),
)


def test_every_estimate(spark):
    rows = spark.createDataFrame(ESTIMATES, "amount string, site long, export long")
    got = rows.select("site", "export", brackets.midpoint(F.col("amount")).alias("s"), brackets.midpoint(F.col("amount"), "export").alias("e")).collect()
    assert all((r.site, r.export) == (r.s, r.e) for r in got) and len(got) == len(brackets.BRACKETS)


@pytest.mark.parametrize("level, name, target", [("Level I", "x", True), ("Level II", None, True), ("level i", "x", False), (None, "Trump, Donald J", True), ("Level III", "Trump, Donald J.", True), (None, "trump, donald j", False), (None, None, False)])
def test_target_levels(spark, level, name, target):
    df = spark.createDataFrame([(level, name)], "level string, name string")
    assert df.select(classify.is_target_level(F.col("level"), F.col("name"))).first()[0] is target


@pytest.mark.parametrize(
    "text, kind",
    [("A Certificate of Divestiture", "certificate_of_divestiture"), ("Conflict of Interest Waiver", "conflict_waiver"), ("Certification of Ethics Agreement Compliance", "compliance_cert"), ("Ethics Agreement", "ethics_agreement"),
     ("Nominee 278", "nominee_278"), ("278 Transaction", "transaction_278t"), ("form 278T.", "transaction_278t"), ("278TX", "other"), ("\u00e9278T", "transaction_278t"), ("", "other")],
)
def test_document_kinds(spark, text, kind):
    assert one(spark, classify.document_kind(F.col("t")), t=text) == kind


def test_links_and_labels(spark):
    link = scalars.pdf_link(F.col("h"), "https://base.example/api/v2")
    assert one(spark, link, h="<a href='/x/a_b.PDF'>") == "https://base.example/x/a_b.PDF"
    assert one(spark, link, h='<a href="a.pdf">') == "https://base.example/api/a.pdf" and one(spark, link, h="none") is None
    assert one(spark, scalars.plain_label(F.col("h")), h="<b>Ethics</b> form (Request)") == "Ethics form" and one(spark, scalars.plain_label(F.col("h")), h="(x)") == "Disclosure"
    assert one(spark, scalars.file_label(scalars.file_name(F.col("h"))), h="https://x/y/A%20b_c.pdf") == "A b c"
    assert one(spark, scalars.escape_html(F.col("h")), h="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, scalars.page_labels(F.col("p"), F.lit(9).cast("long")), p=1) == [1, 2, 9]
    assert one(spark, scalars.without_fences(F.col("h")), h='```json\n[1]\n```') == "[1]"
    assert one(spark, classify.fee_snippet(F.col("h")), h="x\nThe  filer   paid late fee\ny") == "The filer paid late fee"


def test_keys_ignore_order_and_repeats(spark):
    key = lambda *urls: spark.createDataFrame([(list(urls),)], "u array<string>").select(scalars.idempotency_key(F.col("u"))).first()[0]
    assert key("a", "b", "a") == key("b", "a") != key("a") and len(key("a")) == 64


def test_tokens(spark):
    row = spark.createDataFrame([(7, 1000)], "id long, at long")
    token = tokens.mint(F.col("id"), "confirm", F.col("at"), b"k")
    made = row.select(token.alias("t")).cache()
    check = lambda **o: made.select(tokens.verify(F.col("t"), **({"purpose": "confirm", "now": 1500, "key": b"k"} | o)).alias("v")).first().v
    assert check() == 7
    assert check(purpose="leave") is None and check(key=b"other") is None and check(now=10**9) is None
    bad = made.select(tokens.verify(F.concat("t", F.lit("x")), "confirm", 1500, b"k").alias("v")).first().v
    assert bad is None


def test_repaired_arrays(spark):
    assert one(spark, tokens.repaired_array(F.col("t")), t='```json\n[{"a": 1}, {"a": {"b": "}"}}, {"a":') == '[{"a": 1}, {"a": {"b": "}"}}]'
    assert one(spark, tokens.repaired_array(F.col("t")), t="none") == "[]"


def test_dates_are_dates(spark):
    assert isinstance(one(spark, F.to_date(F.col("t")), t="2020-01-01"), dt.date)


def test_tokens_equal_the_library(spark):
    import base64
    import hashlib
    import hmac

    packed = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    for key in (b"k", b"x" * 64, b"long" * 40):
        made = spark.range(40).select("id", tokens.mint(F.col("id"), "pé", F.col("id") * 7, key).alias("t")).collect()
        for r in made:
            payload = f"{r.id}:pé:{r.id * 7}".encode()
            assert r.t == f"{packed(payload)}.{packed(hmac.new(key, payload, hashlib.sha256).digest())}"
    signed = lambda payload: f"{packed(payload)}.{packed(hmac.new(b'k', payload, hashlib.sha256).digest())}"
    good = signed(b"5:p:1000")
    shown = [(good, 5), (signed(b"5:q:1000"), None), (signed(b"5:p:1601"), None), (signed(b"5:p:999"), None), (signed(b"5:p:1600"), 5), (signed(b"x:p:1000"), None), (signed(b"5:p:x"), None), (signed(b"5:p"), None), (signed(b"5:p:1000:2"), None)]
    shown += [(good + ".x", None), (good[:-1], None), (good.replace(".", ""), None), ("", None), (None, None), (".", None), ("a.b", None), ("é!.x", None), (signed(b"\xff\xfe"), None)]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(shown)], "k int, t string").select("k", tokens.verify(F.col("t"), "p", 1600, b"k", 600).alias("v"))
    assert {r.k: r.v for r in rows.collect()} == {k: v for k, (_, v) in enumerate(shown)}
