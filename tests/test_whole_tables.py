"""Queries that read whole tables: no row of their inputs is left out."""

import re
from pathlib import Path

import pytest

from folioflow.functions import brackets
from folioflow.plans import registry
from folioflow.plans.model import transactions

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@needs_data
def test_reconcile_counts_every_sale_and_part(spark):
    rows = registry.QUERIES["j5_u8_t14_reconcile_all"](spark, DATA).collect()
    tx = transactions(spark, DATA)
    assert sum(r.sales for r in rows) == tx.filter(brackets.is_sale(tx.type) & (tx.ticker != "")).count()
    held = spark.read.parquet(f"{DATA}/part.parquet").filter("p_brand <> ''")
    worth = held.select(brackets.midpoint(brackets.bracket_of(held.p_retailprice * 40)).alias("v")).collect()
    assert sum(r.entry_value for r in rows) == sum(r.v for r in worth)
    assert {r.status for r in rows} == {"exempt", "sold", "no-sale-on-file"} and any(r.description.startswith("Sold (") for r in rows)


@needs_data
def test_golden_has_every_line(spark):
    got = registry.QUERIES["j13_x46_golden_all"](spark, DATA)
    assert got.count() == transactions(spark, DATA).select("filing", "line").distinct().count()


def test_snippets_of_any_language(spark, tmp_path):
    texts = [None, "", "the and", "caf\u00e9 \U0001f600 THE\u00a0 And \u00fc" * 9, "x" * 200 + "and\nthe" + "y" * 200, "\u4e2d" * 90 + " the  and\u2028 z", "a\u0085the and\rb", "thee and"]
    rows = [(k, t, ("de", "en", None)[k % 3], "s", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.snippet for r in registry.QUERIES["f23_snippets_all"](spark, str(tmp_path)).collect()}
    space = "[\\t-\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    line = "[^\\n\\r\u2028\u2029]{0,80}"
    found = {k: re.search(f"{line}(the{space}+and|and{space}+the){line}", t or "", re.I) for k, t in enumerate(texts)}
    assert got == {k: re.sub(f"{space}+", " ", m[0]).strip(" ") for k, m in found.items() if m}
