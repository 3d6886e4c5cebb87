"""Quality rules: a threshold table compiled into one Spark projection.

Every rule compares an integer measure with a ratio of another measure, so that no rounding
decides a verdict: a rule ``(name, measure, sign, factor, base)`` holds when
``measure * 100 sign factor * base``. The compiled projection has one boolean per rule and the
list of the names of broken rules; no user function is evaluated.

Edge cases: a null or empty text has no words and fails the base rule ``n_words >= 10``; very long
texts are measured whole, in n log n; repeated
rows each get their own verdict; an empty table gives an empty result; input columns with the
names of output columns are ignored unless the caller keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import words

#: Function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for on with as was are be by this from or an a",
    "de": "der die und das den von zu mit des im ein eine ist auf für nicht sich dem auch in",
    "fr": "le la les de des et un une du en que qui dans pour par est sur au avec",
    "es": "el la los las de que y en un una del por con para es se no su al",
}
ALL_STOP_WORDS = sorted({w for line in STOP_WORDS.values() for w in line.split()})

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Holds when 100 * measure is at most (or at least) factor * base."""

    name: str
    measure: str
    sign: str
    factor: int
    base: str

    def holds(self) -> Column:
        left, right = F.col(self.measure) * 100, F.col(self.base) * self.factor
        return left <= right if self.sign == "<=" else left >= right


#: Rules that fail a document whatever else it has.
BASE_RULES = (
    Rule("enough_words", "n_words", ">=", 1000, "one"),
    Rule("few_repeated_windows", "n_repeat_words", "<=", 20, "n_words"),
)
#: The threshold table of the method: length, symbol, stop-word and line ratios.
THRESHOLDS = (
    Rule("words_long_enough", "word_chars", ">=", 200, "n_words"),
    Rule("words_short_enough", "word_chars", "<=", 1500, "n_words"),
    Rule("few_symbols", "n_symbols", "<=", 10, "n_words"),
    # Of the words past the first fifty: chance alone leaves a short text without any. The lists are of languages with Latin
    # letters, so texts in other scripts are not judged by them.
    Rule("enough_stop_words", "n_stop_words", ">=", 5, "latin_words_past_50"),
    # A line or two that come twice in a text of few lines say nothing.
    Rule("few_repeated_lines", "n_dup_lines", "<=", 30, "lines_and_4"),
)
#: What rules compare with, beside the measures, as SQL of the measures.
BASES = {
    "one": "1L",
    "latin_words_past_50": "CASE WHEN 2 * n_latin >= word_chars THEN n_words - 50 ELSE 0L END",
    "lines_and_4": "n_lines + 4L",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_latin", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the array of window hashes.

    Sorting (hash, place) pairs puts equal windows side by side, which stays n log n for a text
    that is one word over and over; each window then adds the words that the one before it,
    by place, has not covered.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        F.array(pairs),
        F.lit(0).cast("long"),
        lambda _, p: F.aggregate(
            F.sort_array(
                F.transform(
                    F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
            lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total")),
            lambda a: a["total"],
        ),
    )


def measure(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measures of each text, as longs, next to the columns in keep."""
    size = lambda c: F.size(c).cast("long")
    parted = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumns(
        {
            "__words": words(F.col("__text")),
            "__lines": F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    hashed = parted.withColumn(
        "__windows",
        F.when(
            F.size("__words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("__words") - WINDOW),
                lambda i: F.xxhash64(*(F.get(F.col("__words"), i + j) for j in range(WINDOW))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return hashed.select(
        *keep,
        size("__words").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("__text") - F.length(F.translate("__text", LATIN, ""))).cast("long").alias("n_latin"),
        size(F.filter("__words", lambda w: F.lower(w).isin(ALL_STOP_WORDS))).alias("n_stop_words"),
        size("__lines").alias("n_lines"),
        (size("__lines") - size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), F.lit(0).cast("long"))
        .otherwise(_covered(F.col("__windows")))
        .alias("n_repeat_words"),
    )


def verdicts(measured: DataFrame, thresholds: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Adds base_failed, kept and broken_rules to measured rows, by one projection."""
    base = ~F.expr("true")
    rows = measured.withColumns({name: F.expr(sql) for name, sql in BASES.items()})
    for rule in BASE_RULES:
        base = base | ~rule.holds()
    fine = F.lit(True)
    for rule in thresholds:
        fine = fine & rule.holds()
    broken = F.array_compact(F.array(*(F.when(~r.holds(), F.lit(r.name)) for r in (*BASE_RULES, *thresholds))))
    return rows.select(*measured.columns, base.alias("base_failed"), (~base & fine).alias("kept"), broken.alias("broken_rules"))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose text passes all rules, with df's own columns."""
    columns = df.columns
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col(f"`{text_col}`").alias("__source"))
    # Numbering the rows keeps the filter above the measures: pushed below, it would measure anew for every rule.
    measured = measure(held, "__source", ("__row",)).withColumn("__at", F.monotonically_increasing_id())
    good = verdicts(measured).filter("kept AND __at >= 0")
    return good.select(*(F.col("__row").getField(c).alias(c) for c in columns))
