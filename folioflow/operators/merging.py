"""Merges of re-filed rows, and dedupes with their rules of which row stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.rollups import total


def row_key() -> Column:
    """A row's identity across filings: description and type without case, date and amount."""
    return F.concat_ws("|", F.lower(F.trim("description")), F.col("date").cast("string"), F.lower("type"), F.col("amount"))


def multiset_merge(existing: DataFrame, filings: DataFrame) -> DataFrame:
    """Rows to add so that every key is there as often as in that one filing, or in what exists, that has it most.

    Both have description, date, type, amount; filings also filing and line, in whose order rows are taken. A filing
    that restates rows adds nothing; rows that one filing lists several times are kept apart.
    """
    have = existing.groupBy(row_key().alias("key")).agg(F.count("*").alias("have"))
    keyed = filings.withColumn("key", row_key())
    want = keyed.groupBy("key", "filing").agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("want"))
    missing = want.join(have, "key", "left").select("key", (F.col("want") - F.coalesce("have", F.lit(0))).alias("missing")).filter("missing > 0")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("filing", "line", "part", "supplier"))
    return keyed.join(missing, "key").withColumn("nth", nth).filter("nth <= missing").drop("key", "nth", "missing")


def multiset_targets(existing: DataFrame, filings: DataFrame) -> DataFrame:
    """For each key how often it is there, how often it is to be, and how many rows are added."""
    have = existing.groupBy(row_key().alias("key")).agg(F.count("*").alias("have"))
    want = filings.groupBy(row_key().alias("key"), "filing").agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("want"))
    both = have.join(want, "key", "full_outer").select("key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("have", "want")))
    return both.withColumns({"target": F.greatest("have", "want"), "added": F.greatest(F.lit(0), F.col("want") - F.col("have"))})


def set_merge(existing: DataFrame, filings: DataFrame) -> DataFrame:
    """The older merge: one row for each key that isn't there yet."""
    fresh = filings.withColumn("key", row_key()).join(existing.select(row_key().alias("key")).distinct(), "key", "left_anti")
    return fresh.groupBy("key").agg(F.count("*").alias("filed"), F.min(F.struct("filing", "line", "part", "supplier")).alias("f")).select("key", "filed", "f.*")


def keep_one(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def keep_first_text(rows: DataFrame, text: str, id_: str) -> DataFrame:
    """Each different text with its least id.

    Texts are told apart by two hashes and their length first, so that only those that may have a copy are shuffled, and
    compared as they are; a text that has none goes straight through.
    """
    mark = {"__h": F.xxhash64(text), "__m": F.md5(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))), "__n": F.coalesce(F.length(text), F.lit(-1))}
    marked = rows.select(text, id_).withColumns(mark)
    repeated = marked.groupBy(*mark).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    alone = marked.join(repeated, [*mark], "left_anti").select(text, id_)
    return alone.unionByName(marked.join(repeated, [*mark], "left_semi").groupBy(text).agg(F.min(id_).alias(id_)))


def last_write(rows: DataFrame, key: str, fields: list[str], ordinal: Column) -> DataFrame:
    """The last row of each key, with the place of its first."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), ordinal).alias("r"), F.min(ordinal).alias("first_place")).select(key, "r.*", "first_place")


def occurrences(rows: DataFrame, order: list[str]) -> DataFrame:
    """Numbers the repeats of a key within a filing."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(row_key(), "filing").orderBy(*order)).cast("long"))


def duplicates(rows: DataFrame, group: str, key: list[str]) -> DataFrame:
    """Rows less distinct keys in each group that has any repeat; counted in two steps, so no group meets in one task."""
    per = rows.groupBy(group, *key).agg(F.count("*").alias("n"))
    return per.groupBy(group).agg(total(F.col("n") - 1).alias("duplicates")).filter("duplicates > 0")


def replace_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All rows of new, and those of old whose source new doesn't restate."""
    return old.join(new.select(source).distinct(), source, "left_anti").select(*new.columns).unionByName(new)


def merge_rows(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Review changes applied to a table: delete, approve (the flag goes) or edit (listed columns and the flag).

    changes: key, action, and new values of the columns; a null value leaves its column as it is.
    """
    both = old.alias("o").join(changes.alias("c"), key, "left")
    kept = both.filter("coalesce(action, '') <> 'delete'")
    edited = [F.when(F.col("action") == "edit", F.coalesce(F.col(f"c.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    same = [F.col(f"o.{c}") for c in old.columns if c not in (key, "flagged", *columns)]
    return kept.select(key, *edited, *same, F.when(F.col("action").isNotNull(), F.lit(False)).otherwise(F.col("flagged")).alias("flagged"))


def upsert_follow(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sign-ups merged by e-mail: a confirmed follow of all is never narrowed to one slug."""
    joined = old.alias("o").join(new.alias("n"), "email", "full_outer")
    wide = (F.col("o.status") == "active") & F.col("o.slug").isNull()
    slug = F.when(F.col("o.status").isNull(), F.col("n.slug")).when(F.col("n.status").isNull() | wide, F.col("o.slug")).otherwise(F.col("n.slug"))
    return joined.select("email", F.coalesce("o.status", "n.status").alias("status"), slug.alias("slug"))
