"""Scalar functions on names, dates, money, labels and links, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in press style.
PRESS_MONTHS = ("Jan.", "Feb.", "March", "April", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec.")
#: Words of offices and agencies that say nothing.
OFFICE_STOP_WORDS = [
    "department",
    "office",
    "of",
    "the",
    "and",
    "administration",
    "commission",
    "agency",
    "bureau",
    "us",
    "united",
    "states",
    "executive",
    "national",
    "federal",
    "council",
    "secretary",
    "director",
]
#: Short names of agencies.
AGENCY_SHORT = {
    "Office of Science and Technology Policy": "OSTP",
    "Social Security Administration": "SSA",
    "Department of Transportation": "DOT",
    "National Aeronautics and Space Administration": "NASA",
    "Council of Economic Advisers": "CEA",
    "Office of Personnel Management": "OPM",
    "Department of Homeland Security": "DHS",
    "Department of Health and Human Services": "HHS",
    "Department of Veterans Affairs": "VA",
    "Department of Justice": "DOJ",
    "Environmental Protection Agency": "EPA",
    "Office of National Drug Control Policy": "ONDCP",
    "Department of the Interior": "Interior",
    "Department of Agriculture": "USDA",
    "Department of the Treasury": "Treasury",
    "Federal Highway Administration": "FHWA",
    "Federal Transit Administration": "FTA",
}
#: Names that a source writes in two ways.
NAME_ALIASES = {
    "Trump, Donald J": "Trump, Donald J.",
    "Wright, Christopher A": "Wright, Christopher",
    "McMahon, Linda E": "McMahon, Linda",
    "Sonderling, Keith": "Sonderling, Keith E",
    "Lawrence, Paul": "Lawrence, Paul R",
    "Miran, Stephen": "Miran, Stephen I",
}
#: Upper-case words in brackets that aren't tickers.
NOT_TICKERS = ("DRS", "IRA", "LP", "LLC", "LLP", "INC")
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


# -- money and numbers -------------------------------------------------------------------


def compact_currency(value: Column) -> Column:
    """$1.2M style; units are never promoted after rounding, and exact ties round up."""
    tenths = lambda unit: F.floor((value * 10 + unit // 2) / unit).cast("long")
    one_place = lambda unit, mark: F.concat(F.lit("$"), F.floor(tenths(unit) / 10).cast("string"), F.lit("."), (tenths(unit) % 10).cast("string"), F.lit(mark))
    return (
        F.when(value >= 1_000_000_000, one_place(1_000_000_000, "B"))
        .when(value >= 1_000_000, one_place(1_000_000, "M"))
        .when(value >= 1_000, F.concat(F.lit("$"), F.floor((value + 500) / 1000).cast("string"), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), value.cast("string")))
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; zero of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("long")


def counted(n: Column, noun: str) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


# -- names -------------------------------------------------------------------------------


def display_name(name: Column) -> Column:
    """Last, First becomes First Last; parts after the second are left out."""
    parts = F.transform(F.split(name, ","), lambda p: F.trim(p))
    return F.when(F.size(parts) >= 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(name)


def reversed_name(name: Column) -> Column:
    """All parts in reverse order."""
    return F.array_join(F.reverse(F.transform(F.split(name, ","), lambda p: F.trim(p))), " ")


def initials(shown: Column) -> Column:
    parts = F.filter(F.split(shown, " "), lambda p: p != "")
    first = lambda c: F.substring(c, 1, 1)
    return F.upper(F.when(F.size(parts) >= 2, F.concat(first(F.get(parts, F.lit(0))), first(F.element_at(parts, -1)))).otherwise(F.substring(shown, 1, 2)))


def canonical_name(name: Column) -> Column:
    aliases = F.create_map(*(F.lit(x) for pair in NAME_ALIASES.items() for x in pair))
    return F.coalesce(aliases[name], name)


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug(name: Column, swap_all: bool = False) -> Column:
    """A name's slug: its first two parts swapped, or all of them reversed."""
    parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: p != "")
    pair = F.when(F.size(parts) > 1, F.array(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(parts)
    return _dashed(F.array_join(F.reverse(parts) if swap_all else pair, " "))


def level_name(raw: Column) -> Column:
    clean = F.trim(raw)
    return F.when(raw.isNull() | (raw == ""), "Unknown").when(clean == "Level I", "Cabinet").when(clean == "Level II", "Sub-Cabinet").otherwise(clean)


# -- offices -----------------------------------------------------------------------------


def significant_tokens(text: Column) -> Column:
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    return F.array_except(F.array_distinct(tokens), F.array(*map(F.lit, OFFICE_STOP_WORDS)))


def shown_agency(role: Column, agency: Column) -> Column:
    """The agency when it adds anything to the role, else null."""
    own = significant_tokens(agency)
    silent = (agency == "") | (role == "") | (F.size(own) == 0) | F.arrays_overlap(own, significant_tokens(role))
    return F.when(~F.coalesce(silent, F.lit(True)), agency)


def shown_role(role: Column, agency: Column) -> Column:
    return F.when(F.coalesce(role, F.lit("")) == "", agency).otherwise(role)


def office_line(role: Column, agency: Column) -> Column:
    return F.concat_ws(" · ", shown_role(role, agency), shown_agency(role, agency))


def office_line_short(role: Column, agency: Column) -> Column:
    """The line with known agencies abbreviated, longest first."""
    pairs = sorted(AGENCY_SHORT.items(), key=lambda p: -len(p[0]))
    return reduce(lambda line, p: F.replace(line, F.lit(p[0]), F.lit(p[1])), pairs, office_line(role, agency))


# -- dates -------------------------------------------------------------------------------


def press_date(text: Column) -> Column:
    date = F.try_to_date(F.when(F.contains(text, F.lit("T")), F.substring(text, 1, 10)).otherwise(text), "yyyy-MM-dd")
    month = F.get(F.array(*map(F.lit, PRESS_MONTHS)), F.month(date) - 1)
    return F.coalesce(F.concat(month, F.lit(" "), F.dayofmonth(date).cast("string"), F.lit(", "), F.year(date).cast("string")), F.lit("Unknown date"))


def month_key(text: Column) -> Column:
    """The first seven characters when they look like a month."""
    return F.nullif(F.regexp_extract(text, r"^\d{4}-\d{2}", 0), F.lit(""))


def next_month(key: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(key, F.lit("-01"))), 1), "yyyy-MM")


def month_short(key: Column) -> Column:
    return F.date_format(F.to_date(F.concat(key, F.lit("-01"))), "MMM yyyy")


# -- tickers, links and labels -----------------------------------------------------------


def trailing_ticker(ticker: Column, description: Column) -> Column:
    """The ticker, or else one in brackets at the description's end."""
    return F.coalesce(ticker, F.nullif(F.regexp_extract(description, r"\(([A-Z]{1,6})\)\s*$", 1), F.lit("")))


def holding_ticker(description: Column) -> Column:
    found = F.regexp_extract(description, r"\(([A-Z]{2,6}(?:\.[A-Z])?)\)", 1)
    return F.when((found != "") & ~found.isin(*NOT_TICKERS), found)


def show_ticker(description: Column, ticker: Column) -> Column:
    return F.coalesce((ticker != "") & ~F.contains(description, F.concat(F.lit("("), ticker, F.lit(")"))), F.lit(False))


def company_name(description: Column) -> Column:
    return F.trim(F.regexp_replace(description, r"\s*\([^)]*\)\s*$", ""))


def pdf_link(html: Column, base: str) -> Column:
    """The first linked PDF; one without a scheme is put under base."""
    found = F.nullif(F.regexp_extract(html, r"(?i)href=[\"']([^\"']+\.pdf)[\"']", 1), F.lit(""))
    root = "/".join(base.split("/")[:3])
    folder = base.rsplit("/", 1)[0]
    return F.when(found.startswith("http"), found).when(found.startswith("/"), F.concat(F.lit(root), found)).otherwise(F.concat(F.lit(folder + "/"), found))


def file_name(url: Column) -> Column:
    return F.url_decode(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1))


def file_label(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit("_"), F.lit(" "))


def plain_label(html: Column, default: str = "Disclosure") -> Column:
    """Text without tags and without a remark in brackets at its end."""
    text = F.trim(F.regexp_replace(html, r"<[^>]+>", ""))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, r"\s*\(.*\)\s*$", "")), F.lit("")), F.lit(default))


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def clean_text(text: Column, most: int) -> Column:
    return F.substring(F.nullif(F.trim(text), F.lit("")), 1, most)


def first_address(forwarded: Column) -> Column:
    return F.trim(F.get(F.split(forwarded, ","), F.lit(0)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def parent_item(number: Column) -> Column:
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.[^.]+$", ""))


def without_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def page_labels(page: Column, last: Column) -> Column:
    """Page numbers shown by a pager: the first, the last and the neighbourhood of the page."""
    numbers = F.array(F.lit(1).cast("long"), page - 1, page, page + 1, last)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda p: (p >= 1) & (p <= last))))


def idempotency_key(urls: Column) -> Column:
    """One hash for a set of links, whatever their order and repeats."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(urls)), "\n"), 256)


def subject(name: Column, n: Column) -> Column:
    """A mail's subject: the one official's name, or how many there are."""
    return F.when(n == 1, F.concat(name, F.lit(": new filing"))).otherwise(F.concat(n.cast("string"), F.lit(" new filings")))


def nonzero_text(counts: dict[str, Column]) -> Column:
    """The counts that aren't zero, named, in one text."""
    return F.concat_ws(", ", *(F.when(n > 0, F.concat(F.lit(f"{name}: "), n.cast("string"))) for name, n in counts.items()))
