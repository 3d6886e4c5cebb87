import random
import re

import pytest

from folioflow.functions import brackets, classify
from folioflow.operators import reports

DOCS = "doc_id long, text string"


def by_anchors(text, anchors):
    """Sections as a loop over lines finds them."""
    lines = (text or "").split("\n")
    starts = {}
    for rank, (name, pattern) in enumerate(anchors):
        for at, line in enumerate(lines):
            if re.search(pattern, line):
                starts[name] = (at, rank)
                break
    marks = [(0, -1, None), *sorted((at, rank, name) for name, (at, rank) in starts.items())]
    out = []
    for k, (at, _, name) in enumerate(marks):
        stop = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        if stop > at:
            out.append((name, at, stop - at, "\n".join(lines[at:stop])))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_sections_equal_the_loop_and_keep_the_text(spark, seed):
    rng = random.Random(seed)
    anchors = [("one", r"^\s*1\.?\s"), ("two", r"^\s*2\.?\s"), ("any", r"^\s*[12]"), ("end", r"^End\b"), ("no", "^never$")]
    line = lambda: rng.choice(["1. a", " 2 b", "12", "End", "Ending", "", "text", "  ", "é", "1", "x 1. y"])
    texts = [(k, "\n".join(line() for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(900, None), (901, ""), (902, "\n\n"), (903, "1. a\n" * 3000 + "End"), (903, "1. a\n" * 3000 + "End")]
    df = spark.createDataFrame([(*t, 5, "s") for t in texts], f"{DOCS}, section long, body string")
    rows = reports.split_sections(df, anchors).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["section"], r["start_line"], r["n_lines"], r["body"]))
    for doc_id, text in texts:
        got, want = sorted(found[doc_id], key=lambda s: s[1]), by_anchors(text, anchors)
        if doc_id == 903:
            assert got == sorted(want * 2, key=lambda s: s[1])
        else:
            assert got == want and "\n".join(s[3] for s in got) == (text or "")
    assert reports.split_sections(spark.createDataFrame([], DOCS), anchors).collect() == []
    assert {r["section"] for r in reports.split_sections(df, []).collect()} == {None}


def by_lines(text):
    """Holdings as a loop over lines with an open one finds them."""
    out, held = [], None
    for raw in (text or "").split("\n"):
        line = raw.rstrip()
        if not line or any(re.search(p, line) for p in reports.SKIPPED) or re.match(reports.HEADING, line):
            continue
        m = re.match(reports.ITEM, line)
        if m:
            held = [m.group(1), m.group(2)]
            out.append(held)
        elif held is not None:
            held.append(line)
    rows = []
    for k, (item, *lines) in enumerate(out):
        text = " ".join(lines)

        def peel(pattern):
            nonlocal text
            m = re.search(pattern, text)
            if m:
                text = text[: m.start()] + " " + text[m.end() :]
            return m.group(0) if m else None

        value, amount = peel(reports.VALUE), peel(reports.INCOME)
        exact = peel(reports.DOLLARS) if amount is None else None
        eif = peel(reports.FLAG)
        m = re.search(reports.TICKER, text)
        ticker = m.group(1) if m and 2 <= len(m.group(1)) <= 6 and m.group(1) not in reports.NO_TICKERS else None
        left = re.sub(r"\s+", " ", text).strip()
        kind = next((t for t in sorted(reports.INCOME_TYPES, key=len, reverse=True) if t in left), None)
        left = left.replace(kind, " ").strip() if kind else left
        tidy = lambda x: re.sub(r"\s+", " ", x).strip() if x else None
        rows.append((k + 1, item, ".".join(item.split(".")[:-1]) or None, tidy(left).strip(" -,") if left else "", ticker, eif, eif == "Yes", tidy(value), kind, tidy(amount), exact))
    return rows


def test_holdings_equal_the_loop(spark):
    rng = random.Random(3)
    words = [*list(brackets.HOLDING_MIDPOINTS), *classify.INCOME_BUCKETS, *reports.INCOME_TYPES, "(ABC)", "(K)", "(LLC)", "(BRK.B)", "(TOOLONGX)", "N/A", "No", "Yes", "See Endnote", "Nothing", "$5", "$1,234.50", "Fund - ", "trust,", "401(K)"]

    def line():
        start = rng.choice(["", "", "", f"{rng.randint(1, 30)} ", f"{rng.randint(1, 9)}.{rng.randint(1, 9)}\t", "1.2.3.4.5 ", "1.2.3.4.5.6 ", "2. Filer's ", "3 Other ", "AMOUNT", "# DESCRIPTION", "Doe, Jan - Page 12 ", "TYPE HELD  ", "FROM  TO", "7"])
        return start + " ".join(rng.choice(words).replace(" ", rng.choice([" ", " ", "  "])) for _ in range(rng.randint(0, 4))) + rng.choice(["", " ", "\t"])

    texts = [(k, "\n".join(line() for _ in range(rng.randint(0, 15)))) for k in range(300)] + [(900, None), (901, ""), (902, "no item\nat all"), (903, "1 " + "word " * 20000 + "\n" + "more\n" * 5000)]
    df = spark.createDataFrame([(*t, "v", 1) for t in texts], f"{DOCS}, value string, item int")
    found = {}
    for r in reports.holdings(df, keep=("doc_id",)).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for doc_id, text in texts:
        assert sorted(found.get(doc_id, [])) == by_lines(text), doc_id
    assert sum(map(len, found.values())) > 300
    assert reports.holdings(spark.createDataFrame([], DOCS)).collect() == []


def test_a_kept_column_may_have_the_name_of_a_part(spark):
    df = spark.createDataFrame([("k", "1 a $7")], "`__rest` string, text string")
    assert [tuple(r)[:4] for r in reports.holdings(df, keep=("__rest",)).collect()] == [("k", 1, "1", None)]


def test_words_equal_the_loop(spark):
    rng = random.Random(4)
    columns = [("a", 0.0, 10.0), ("b", 10.0, 20.5), ("c", 30.0, 31.0)]
    words = [(rng.choice([1, 2, None]), rng.randint(0, 1), rng.choice([0.0, 10.0, 20.0, 20.5, 30.0, 31.0, rng.random() * 40, None]), rng.choice([0.0, 1.0, 1.5, 4.5, 7.5, 3.0, rng.random() * 30]), rng.choice(["x", "y", "zz", "", None])) for _ in range(400)]
    words += words[:20]
    want = {}
    for doc, page, x, y, word in words:
        name = next((c for c, low, high in columns if x is not None and low <= x < high), None)
        if name and word:
            want.setdefault((doc, page, round(y / 3) * 3), {}).setdefault(name, []).append((x, word))
    want = {k: tuple(" ".join(w for _, w in sorted(v.get(c, []))) for c, _, _ in columns) for k, v in want.items()}
    df = spark.createDataFrame(words, "doc long, page int, x double, y double, word string")
    rows = reports.in_columns(df, columns, ["doc", "page"]).collect()
    assert {(r["doc"], r["page"], r["y"]): (r["a"], r["b"], r["c"]) for r in rows} == want and len(rows) == len(want)
