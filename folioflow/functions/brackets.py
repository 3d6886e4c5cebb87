"""Bracketed amounts: statutory ranges instead of exact values."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Range, least value, estimate, short label.
BRACKETS = (
    ("$1,001-$15,000", 1_001, 8_000, "$1K-$15K"),
    ("$15,001-$50,000", 15_001, 32_500, "$15K-$50K"),
    ("$50,001-$100,000", 50_001, 75_000, "$50K-$100K"),
    ("$100,001-$250,000", 100_001, 175_000, "$100K-$250K"),
    ("$250,001-$500,000", 250_001, 375_000, "$250K-$500K"),
    ("$500,001-$1,000,000", 500_001, 750_000, "$500K-$1M"),
    ("$1,000,001-$5,000,000", 1_000_001, 3_000_000, "$1M-$5M"),
    ("$5,000,001-$25,000,000", 5_000_001, 15_000_000, "$5M-$25M"),
    ("$25,000,001-$50,000,000", 25_000_001, 37_500_000, "$25M-$50M"),
    ("Over $50,000,000", 50_000_001, 75_000_000, "$50M+"),
    ("Over $1,000,000", 1_000_001, 1_500_000, "$1M+"),
)
#: The open bracket that the export variant doesn't know and counts as nothing, and its place.
EXPORT_UNKNOWN = "Over $1,000,000"
OPEN_PLACE = 10
#: Holdings use spaced ranges and have a bracket below the least one.
HOLDING_MIDPOINTS = {"None (or less than $1,001)": 500, **{r.replace("-", " - "): m for r, _, m, _ in BRACKETS if r != EXPORT_UNKNOWN}}

TYPES = ("Sale", "Sale (Partial)", "Sale (Full)", "Purchase", "Exchange")
SALES = TYPES[:3]


def _lookup(key: Column, values: dict, kind: str) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v).cast(kind)) for k, v in values.items()))[key]


def least(amount: Column) -> Column:
    return _lookup(amount, {b[0]: b[1] for b in BRACKETS}, "long")


def label(amount: Column) -> Column:
    return _lookup(amount, {b[0]: b[3] for b in BRACKETS}, "string")


def midpoint(amount: Column, variant: str = "site") -> Column:
    """The estimate of a bracket; an unknown one is null for the site and zero for exports."""
    if variant == "site":
        return _lookup(amount, {b[0]: b[2] for b in BRACKETS}, "long")
    return F.coalesce(_lookup(amount, {b[0]: b[2] for b in BRACKETS if b[0] != EXPORT_UNKNOWN}, "long"), F.lit(0).cast("long"))


def holding_midpoint(value: Column) -> Column:
    return F.coalesce(_lookup(value, HOLDING_MIDPOINTS, "long"), F.lit(0).cast("long"))


def _closed(value: Column, results: Sequence) -> Column:
    out = F.when(value >= BRACKETS[9][1], results[9])
    for (_, low, _, _), result in zip(reversed(BRACKETS[1:9]), reversed(results[1:9]), strict=True):
        out = out.when(value >= low, result)
    return out.otherwise(results[0])


def bracket_of(value: Column) -> Column:
    """The closed bracket that a value falls into."""
    return _closed(value, [b[0] for b in BRACKETS])


def place_of(value: Column) -> Column:
    """The place in BRACKETS of the closed bracket that a value falls into: one byte, for rows that are shuffled."""
    return _closed(value, range(len(BRACKETS))).cast("byte")


def bracket_at(place: Column) -> Column:
    return F.lit([b[0] for b in BRACKETS])[place]


def is_sale(kind: Column) -> Column:
    return kind.isin(*SALES)


# The same lookups as SQL text, for the oracle.


def sql_case(column: str, field: int, *, export: bool = False) -> str:
    rows = [b for b in BRACKETS if not (export and b[0] == EXPORT_UNKNOWN)]
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    cases = " ".join(f"WHEN '{b[0]}' THEN {value(b[field])}" for b in rows)
    return f"CASE {column} {cases}{' ELSE 0' if export else ''} END" if field == 3 else f"CAST(CASE {column} {cases}{' ELSE 0' if export else ''} END AS BIGINT)"


def sql_bracket_of(value: str) -> str:
    cases = " ".join(f"WHEN {value} >= {low} THEN '{name}'" for name, low, _, _ in reversed(BRACKETS[1:10]))
    return f"CASE {cases} ELSE '{BRACKETS[0][0]}' END"
