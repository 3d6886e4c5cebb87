"""Selection of a digest: what is new against a ledger, whose it is, and who gets it.

officials: slug, name, ingested (date text or null), new_count, posted (date text), former.
filings: slug, url, date (text). trades: slug, date, and ordinal columns. ledger: url.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.ordering import numbered, top
from folioflow.session import ship

MAX_TRADES, ALSO_NEW, WINDOW_DAYS = 6, 5, 14


def in_scope(officials: DataFrame, since: str | None) -> DataFrame:
    """Officials ingested on or after a date; a missing date compares as the empty text."""
    return officials if since is None else officials.filter(F.coalesce("ingested", F.lit("")) >= since)


def pending_filings(officials: DataFrame, filings: DataFrame, ledger: DataFrame, since: str | None = None) -> DataFrame:
    """Filings of officials in scope that have a url which the ledger lacks, one row for each url."""
    named = filings.filter(F.coalesce("url", F.lit("")) != "").join(in_scope(officials, since).select("slug"), "slug", "left_semi")
    return named.join(ledger.select("url").distinct(), "url", "left_anti").groupBy("url").agg(F.min("slug").alias("slug"), F.max("date").alias("date"))


def items(officials: DataFrame, pending: DataFrame, near: Column | None = None) -> DataFrame:
    """A card for each official with pending filings and a positive count of new rows, in order of that count.

    near: an expression that rises with slug and has one value for many slugs; places are counted by it.
    """
    per = pending.groupBy("slug").agg(F.count("*").alias("filings"), F.max_by("url", F.struct("date", "url")).alias("primary_url"), F.max("date").alias("posted"))
    cards = officials.filter("new_count > 0").select("slug", "name", "new_count").join(per, "slug")
    near = F.col("slug").cast("string").substr(1, 3) if near is None else near
    return numbered(cards.withColumn("__near", near), {"new_count": False, "__near": True}, [F.asc("slug")], "place").drop("__near")


def trades_shown(cards: DataFrame, trades: DataFrame, order: list[Column], most: int = MAX_TRADES) -> DataFrame:
    """The latest trades of each card, as many as are new and most at the utmost."""
    nth = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("date"), *order))
    return trades.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= most).join(cards.select("slug", "new_count"), "slug").filter("nth <= new_count").drop("new_count")


def also_new(officials: DataFrame, cards: DataFrame, reference: str, k: int = ALSO_NEW, days: int = WINDOW_DAYS) -> DataFrame:
    """Other officials ingested in the days before a reference date, the latest posted first."""
    since = F.date_sub(F.lit(reference).cast("date"), days).cast("string")
    fresh = officials.filter(~F.coalesce("former", F.lit(False)) & (F.coalesce("ingested", F.lit("")) >= since))
    best = fresh.join(cards.select("slug"), "slug", "left_anti").orderBy(F.desc("posted"), "slug").limit(k)
    counted = F.when(F.col("new_count") > 0, F.col("new_count"))
    return best.select("slug", "posted", counted.alias("new_count"), F.row_number().over(Window.orderBy(F.desc("posted"), "slug")).cast("long").alias("place"))


def send_keys(rows: DataFrame, by: list[str], url: str = "url") -> DataFrame:
    """by, send_key and urls: for each group the hash of its different urls, sorted, a line each, and how many there are.

    A hash takes its input in order, so a group's urls pass one task, but as a sorted stream of which no more than one is held. Groups of null
    urls alone have none; without by, all rows are one group and there is one row even of none.
    """
    ship(rows.sparkSession)
    keys = [F.col(f"`{c}`") for c in by]
    once = rows.filter(F.col(url).isNotNull()).select(*keys, F.col(url).alias("__url")).distinct()
    dealt = once.repartition(*keys) if by else once.repartition(1)
    ordered = dealt.sortWithinPartitions(*keys, "__url")
    kinds = [f"`{c}` {once.schema[c].dataType.simpleString()}" for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, n, types = None, None, 0, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*by, "send_key", "urls"])

        for batch in batches:
            types = [*(batch.schema.field(k).type for k in range(len(by))), pa.string(), pa.int64()]
            for *key, link in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or key != held:
                    if state is not None:
                        done.append((*held, state.hexdigest(), n))
                    held, state, n = key, hashlib.sha256(), 0
                state.update(("\n" if n else "").encode() + link.encode())
                n += 1
            if done:
                yield flush()
        if state is not None:
            done.append((*held, state.hexdigest(), n))
            yield flush()

    return ordered.toDF(*(f"c{k}" for k in range(len(by) + 1))).mapInArrow(run, ", ".join([*kinds, "send_key string", "urls long"]))


def send_key(pending: DataFrame, most: int | None = None) -> DataFrame:
    """One key for the set of pending urls: the hash of the sorted urls, a line each. With most, a send of more is an error."""
    found = send_keys(pending, [])
    none = hashlib.sha256(b"").hexdigest()
    n = F.coalesce(F.max("urls"), F.lit(0)).cast("long")
    key = F.coalesce(F.max("send_key"), F.lit(none))
    fits = F.lit(None).cast("string") if most is None else F.when(n > most, F.raise_error(F.lit(f"more than {most} urls in one send")).cast("string"))
    return found.agg(F.coalesce(fits, key).alias("send_key"), n.alias("urls"))


def draft_lines(cards: DataFrame, officials: DataFrame, trades: DataFrame) -> DataFrame:
    """slug, text: a card's line of the draft, with its official's summary, where there is one, and a line for each trade shown.

    trades: slug, nth, and a text; officials: slug, summary. A card without trades has its heading alone.
    """
    shown = trades.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("t"))
    joined = cards.select("slug", "name", "new_count", "posted").join(officials.select("slug", "summary"), "slug", "left").join(shown, "slug", "left")
    head = F.concat(F.lit("- "), "name", F.lit(": "), F.col("new_count").cast("string"), F.lit(" new trades disclosed. Filing posted on "), F.col("posted").cast("string"), F.lit("."))
    context = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("  Site summary: "), "summary"))
    lines = F.array_join(F.transform("t", lambda x: F.concat(F.lit("    - "), x["text"])), "\n")
    # concat_ws leaves out nulls.
    return joined.select("slug", F.concat_ws("\n", head, context, F.when(F.size("t") > 0, F.lit("  Most recent trades:")), lines).alias("text"))


def follower_text(cards: DataFrame, recipients: DataFrame) -> DataFrame:
    """How many follow each card's official, where any do, in the order of places, as one line."""
    per = recipients.filter("slug IS NOT NULL").groupBy("slug").agg(F.count("*").alias("followers"))
    met = cards.select("slug", "name", "place").join(per, "slug")
    # One pair for each card of a digest; the recipients are counted before.
    one = F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("followers").cast("string"), F.lit(" for "), "name").alias("text"))))
    return met.agg(F.array_join(F.transform(one, lambda x: x["text"]), ", ").alias("text"), F.count("*").alias("cards"))


def chunks(recipients: DataFrame, size: int = 100, ranges: int = 2048) -> DataFrame:
    """Recipients in groups of a size, by id, nulls first: a recipient's place is what the ranges before its own hold, and its place in there.

    The ranges' bounds are approximate quantiles of the ids, so they hold about equally many however the ids are spread, and no
    more than ranges + 1 counts are added up in one task. The bounds have no part in the result.
    """
    value = recipients.withColumn("__value", F.col("id").cast("double"))
    bounds = sorted(set(value.approxQuantile("__value", [k / ranges for k in range(1, ranges)], 1 / ranges))) or [0.0]
    cuts = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__value", outputCol="__range", handleInvalid="keep")
    known = cuts.transform(value.filter("id IS NOT NULL")).unionByName(value.filter("id IS NULL").withColumn("__range", F.lit(-1.0)))
    before = known.groupBy("__range").agg(F.count("*").alias("n"))
    sums = before.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy("id")) - 1
    placed = known.withColumn("__nth", nth).join(F.broadcast(sums), "__range")
    return placed.withColumn("chunk", F.floor((F.col("before") + F.col("__nth")) / size).cast("long")).drop("__range", "__value", "__nth", "before")


def banner(officials: DataFrame, k: int = 3) -> DataFrame:
    """The first k officials, new ones first, and what the rest adds up to: all less those shown."""
    first = top(officials.select("is_new", "new_count", "posted", "slug"), [F.desc("is_new"), F.desc("new_count"), F.desc("posted"), F.asc("slug")], k)
    shown = first.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "slug"))), lambda x: x["slug"]), ",").alias("shown"), F.coalesce(F.sum("new_count"), F.lit(0)).alias("__shown")
    )
    sums = officials.agg(F.count_if(F.col("is_new")).cast("long").alias("new"), F.count_if(~F.col("is_new")).cast("long").alias("updated"), F.coalesce(F.sum("new_count"), F.lit(0)).alias("__all"))
    # One row beside one row.
    return sums.crossJoin(shown).select("new", "updated", "shown", (F.col("__all") - F.col("__shown")).cast("long").alias("overflow"))
