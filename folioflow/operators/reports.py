"""Long reports as lines: sections between headings, holdings that go on over lines, and words placed in rows and columns.

Sections and holdings are found within a report's own row, by functions of its array of lines: no line is shuffled, and a report's length
is bounded by what one text may have. Words of a page come as rows of their own, which meet by page and height, or as one array of a page.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import brackets, classify

#: An item's number at the start of its first line; headings of sections among items.
ITEM = r"^(\d+(?:\.\d+){0,4})\s+(.*)$"
HEADING = r"^\d+\.?\s*(Filer'?s|Spouse'?s|Other)"
#: Decorations of pages.
SKIPPED = (
    r"^# DESCRIPTION",
    r"^AMOUNT\s*$",
    r"^[A-Z][a-z]+, [A-Z][a-z]+ - Page \d+",
    r"^TYPE HELD\s*$",
    r"^# ORGANIZATION NAME",
    r"^TYPE\s+TO\s*$",
    r"^FROM\s+TO\s*$",
)
#: What is white space at a line's end: all that Unicode calls so.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A flag, a sum in dollars, a ticker and what looks like one.
FLAG = r"\b(?:N/A|No|Yes|See Endnote)\b"
DOLLARS = r"\$[\d,]+(?:\.\d+)?"
TICKER = r"\(([A-Z]{1,6}(?:\.[A-Z])?)\)"
NO_TICKERS = ("DRS", "L", "K", "IRA", "LP", "LLC", "LLP", "INC", "P")
#: Kinds of income.
INCOME_TYPES = (
    "Partnership / Distributions",
    "Partnership/Distributions",
    "Salary/Bonus",
    "Salary",
    "Equity Bonus",
    "Bonus",
    "Dividends",
    "Interest",
    "Capital Gains",
    "Rent or Royalties",
    "Rent",
    "Royalties",
    "Distributions",
    "Distribution",
    "Annuity payable to Howard Lutnick per year",
    "BGC Partners - Partnership Distribution (prior to July 2023)",
    "BGCP DRS Distribution",
    "NMRK DRS Distribution",
    "2023 BGC Unit Redemption",
    "Net Income",
)


def any_of(phrases: tuple[str, ...]) -> str:
    """A pattern of phrases, whose blanks stand for any white space."""
    return "(?:" + "|".join(re.escape(p).replace("\\ ", "\\s+") for p in phrases) + ")"


VALUE = any_of(tuple(brackets.HOLDING_MIDPOINTS))
INCOME = any_of(classify.INCOME_BUCKETS)


def lines_of(text: Column) -> Column:
    """A text's lines; a null text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


# -- sections ----------------------------------------------------------------------------


def split_sections(df: DataFrame, anchors: list[tuple[str, str]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, section, start_line, n_lines and body: each text cut where an anchor's first line is.

    anchors: name and pattern of a heading. A section goes on to the next heading's line, whichever anchor that is of; what comes before the first
    heading has the section null. Bodies in the order of start_line, joined by line ends, are the text. Of anchors that
    meet in one line the last has the section; those that are nowhere have none.
    """
    named = df.select(*(F.col(f"`{c}`") for c in keep), lines_of(F.col(f"`{text_col}`")).alias("__lines"))
    lines = F.col("__lines")
    first = lambda pattern: F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")
    starts = [F.struct(first(pattern).alias("at"), F.lit(k + 1).alias("rank"), F.lit(name).alias("name")) for k, (name, pattern) in enumerate(anchors)]
    before = F.struct(F.lit(1).alias("at"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("name"))
    found = F.array_sort(F.filter(F.array(before, *starts), lambda s: s["at"] > 0))
    marked = named.withColumn("__found", found)
    stop = lambda k: F.coalesce(F.try_element_at("__found", k + 2)["at"], F.size(lines) + 1)
    spans = F.filter(F.transform("__found", lambda s, k: F.struct(s["name"].alias("section"), s["at"].alias("at"), (stop(k) - s["at"]).alias("n"))), lambda s: s["n"] > 0)
    rows = marked.withColumn("__span", F.explode(spans))
    body = F.array_join(F.slice(lines, F.col("__span.at"), F.col("__span.n")), "\n")
    return rows.select(*(F.col(f"`{c}`") for c in keep), F.col("__span.section").alias("section"), (F.col("__span.at") - 1).alias("start_line"), F.col("__span.n").alias("n_lines"), body.alias("body"))


# -- holdings ----------------------------------------------------------------------------


def item_lines(text: Column) -> Column:
    """The lines that count: without white space at their ends, empty lines, decorations and headings."""
    # One anchor before all patterns, so that each is tried at a line's start alone.
    skipped = "^(?:" + "|".join(p.removeprefix("^") for p in (*SKIPPED, HEADING)) + ")"
    trimmed = F.transform(lines_of(text), lambda x: F.rtrim(x, F.lit(WHITE)))
    return F.filter(trimmed, lambda x: (x != "") & ~x.rlike(skipped))


def peeled(df: DataFrame, name: str, pattern: str, begins: str, unless: Column | None = None, alone: bool = True) -> DataFrame:
    """Takes the first match of a pattern out of __rest, leaving a blank, into a column of that name; none where unless holds.

    begins: the characters that a match may begin with, asked before the pattern's alternatives. Where a pattern looks at a match alone and not
    at what is beside it, the first place of the match's text is the match, and no second pattern looks for it.
    """
    pattern = f"(?=[{begins}]){pattern}"
    found = F.nullif(F.regexp_extract("__rest", pattern, 0), F.lit(""))
    df = df.withColumn(name, found if unless is None else F.when(~unless, found))
    if alone:
        rest = F.overlay("__rest", F.lit(" "), F.instr("__rest", F.col(name)), F.length(name))
    else:
        rest = F.regexp_replace("__rest", rf"(?s)^(.*?){pattern}(.*)$", "$1 $2")
    return df.withColumn("__rest", F.when(F.col(name).isNotNull(), rest).otherwise(F.col("__rest")))


def _tidy(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", " ")


def holdings(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and ordinal, item, parent, description, ticker, eif, is_eif, value, income_type, income_amount, income_exact.

    A holding begins with a line that has an item's number and goes on over the lines up to the next one; lines before the first
    belong to none. From its text the brackets of value and income, a sum in dollars where there is no bracket of income,
    and a flag are taken out, each at its first place; the longest kind of income that is left is taken out, too, and what remains describes it.
    """
    # Names of its own for what is kept, so that no column of the result hides another.
    kept = [f"__keep{k}" for k in range(len(keep))]
    lined = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)), item_lines(F.col(f"`{text_col}`")).alias("__lines"))
    lines = F.col("__lines")
    places = F.filter(F.transform(lines, lambda x, k: F.when(x.rlike(ITEM), k + 1)), lambda k: k.isNotNull())
    begun = lined.withColumn("__at", places)
    stop = lambda k: F.coalesce(F.try_element_at("__at", k + 2), F.size(lines) + 1)
    items = F.transform("__at", lambda at, k: F.struct(at.alias("at"), (stop(k) - at - 1).alias("more"), (k + 1).alias("ordinal")))
    rows = begun.withColumn("__item", F.explode(items)).withColumn("__first", F.element_at(lines, F.col("__item.at")))
    whole = F.array_join(F.concat(F.array(F.regexp_extract("__first", ITEM, 2)), F.slice(lines, F.col("__item.at") + 1, F.col("__item.more"))), " ")
    out = rows.select(*kept, F.col("__item.ordinal").alias("ordinal"), F.regexp_extract("__first", ITEM, 1).alias("item"), whole.alias("__rest"))
    out = peeled(peeled(out, "__value", VALUE, "$NO"), "__amount", INCOME, "$NO")
    out = peeled(out, "income_exact", DOLLARS, "$", F.col("__amount").isNotNull())
    out = peeled(out, "eif", FLAG, "NYS", alone=False)
    ticker = F.regexp_extract("__rest", TICKER, 1)
    left = out.withColumn("__ticker", ticker).withColumn("__rest", F.trim(_tidy(F.col("__rest"))))
    by_length = sorted(INCOME_TYPES, key=len, reverse=True)
    kind = F.coalesce(*(F.when(F.col("__rest").contains(t), F.lit(t)) for t in by_length))
    # What is tidy stays so where nothing is taken out.
    without = F.when(F.col("income_type").isNull(), F.col("__rest")).otherwise(_tidy(F.replace(F.col("__rest"), F.col("income_type"), F.lit(" "))))
    described = left.withColumn("income_type", kind).withColumn("__rest", without)
    parent = F.when(F.col("item").contains("."), F.regexp_replace("item", r"\.[^.]*$", ""))
    fits = F.length("__ticker").between(2, 6) & ~F.col("__ticker").isin(*NO_TICKERS)
    return described.select(
        *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)),
        "ordinal",
        "item",
        parent.alias("parent"),
        F.trim("__rest", F.lit(" ,-")).alias("description"),
        F.when(fits, F.col("__ticker")).alias("ticker"),
        "eif",
        F.coalesce(F.col("eif") == "Yes", F.lit(False)).alias("is_eif"),
        F.trim(_tidy(F.col("__value"))).alias("value"),
        "income_type",
        F.trim(_tidy(F.col("__amount"))).alias("income_amount"),
        "income_exact",
    )


# -- words in columns --------------------------------------------------------------------


def in_columns(words: DataFrame, columns: list[tuple[str, float, float]], keys: list[str], height: int = 3) -> DataFrame:
    """keys, y and one text for each column: the words (keys, x, y, word) of each row of a page.

    A word's row is its y, rounded to a multiple of height, halves to the even one; its column is the one whose range has its x, edges on the
    left included. Words of a column are joined from left to right, equal places in the order of the words themselves; words
    in no column are left out, and so are rows without any.
    """
    x = F.col("x")
    name = F.coalesce(*(F.when((x >= low) & (x < high), F.lit(c)) for c, low, high in columns))
    placed = words.withColumn("__column", name).filter("__column IS NOT NULL AND word <> ''").withColumn("y", (F.bround(F.col("y") / height) * height).cast("long"))
    texts = placed.groupBy(*keys, "y", "__column").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "word"))), lambda w: w["word"]), " ").alias("__text"))
    own = lambda c: F.coalesce(F.max(F.when(F.col("__column") == c, F.col("__text"))), F.lit(""))
    return texts.groupBy(*keys, "y").agg(*(own(c).alias(c) for c, _, _ in columns))


def pages_in_columns(pages: DataFrame, columns: list[tuple[str, float, float]], keys: list[str], height: int = 3) -> DataFrame:
    """The same rows from pages with all their words: keys, each page once, and words, an array of x, y, word.

    Nothing is shuffled; a task holds a page at a time.
    """
    within = lambda x, low, high: (x >= low) & (x < high)
    row = lambda w: (F.bround(w["y"] / height) * height).cast("long")
    some = lambda w: F.coalesce((w["word"] != "") & reduce(lambda a, b: a | b, (within(w["x"], low, high) for _, low, high in columns)), F.lit(False))
    words = F.transform(F.filter("words", some), lambda w: F.struct(row(w).alias("y"), w["x"].alias("x"), w["word"].alias("word")))
    placed = pages.select(*keys, F.sort_array(words).alias("__words"))
    # Where a row of the sorted words begins; each row goes on to the next one's place.
    begins = lambda w, k: F.when((k == 0) | ~w["y"].eqNullSafe(F.get("__words", k - 1)["y"]), k + 1)
    begun = placed.select(*keys, "__words", F.array_compact(F.transform("__words", begins)).alias("__at"))
    stop = lambda k: F.coalesce(F.try_element_at("__at", k + 2), F.size("__words") + 1)
    lines = begun.select(*keys, F.explode(F.transform("__at", lambda at, k: F.slice("__words", at, stop(k) - at))).alias("__line"))
    own = lambda low, high: F.array_join(F.transform(F.filter("__line", lambda w: within(w["x"], low, high)), lambda w: w["word"]), " ")
    return lines.select(*keys, F.get("__line", F.lit(0))["y"].alias("y"), *(own(low, high).alias(c) for c, low, high in columns))
