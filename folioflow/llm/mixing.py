"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal token counts are given to sources by golden-ratio points that are mapped through
the cumulative targets, so that every stretch of the schedule, however short, has the sources in
nearly their shares. Each source's documents, shuffled by a keyed hash and laid end to end, are
cut into blocks of a slot's size; the k-th slot of a source takes its k-th block. A source whose
target exceeds its size is read a second time from the start, and never a third.

Places within a source and ranks of slots within a source are running sums. They are taken in two
steps, inside buckets of the hash (or runs of the schedule) and over the buckets' totals, so that
no task holds a whole source.

Edge cases: a null text has no words and is never taken; a null source is a source of its own,
ordered last; sizes of zero give targets of zero; repeated rows are separate documents with the
same place in the order; very long texts are counted whole and cut into as many blocks as they take; columns of any name
are handed on by resample; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, cut

SEED = 20_24
PASSES = 2
BLOCK_TOKENS = 256
BUCKETS = 4096
RUN = 1 << 16
CELLS = 1024
#: Sources' rows up to so many bytes are broadcast, each taken for ROW_BYTES beside its name; more meet salted documents.
BROADCAST_BYTES, ROW_BYTES, SALTS = 16 << 20, 200, 64
#: Points are integers modulo SPAN; an odd step near the golden ratio's fraction of it visits all of them.
SPAN = 1 << 31
GOLDEN = int((5**0.5 - 1) / 2 * SPAN) | 1


def sizes(df: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = PASSES) -> DataFrame:
    """Adds target to rows (source, source_size).

    The shares are levelled: with sources in the order of cap to weight, the first ones that can't
    hold their part of what is left are filled to their cap, and the others share the rest by weight.
    One row for each source: the window over all of them is as small as the list of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)).cast("double"))
    level = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    full = F.coalesce(F.sum(F.col("source_size") * cap).over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = ranked.withColumn("rate", (F.sum("source_size").over(everything) * share - full) / weight_left)
    # The first source, in this order, that holds its part sets the rate for itself and all after it;
    # after it the rates only fall.
    holds = F.when(F.col("rate") * F.col("weight") <= F.col("source_size") * cap, F.col("rate"))
    return rows.withColumn("final", F.max(holds).over(everything)).select(
        "source",
        "source_size",
        F.least(F.col("source_size").cast("double") * cap, F.coalesce(F.col("final") * F.col("weight"), F.col("source_size").cast("double") * cap)).alias("target"),
    )


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds name: the sum of amount over the rows of the group before this one, by bucket and order."""
    valued = df.withColumn("__amount", amount)
    per_bucket = valued.groupBy(*group, bucket).agg(F.sum("__amount").alias("__sum"))
    before = per_bucket.withColumn(
        "__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("__sum")
    inside = F.coalesce(F.sum("__amount").over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = " AND ".join(f"a.{c} <=> b.{c}" for c in (*group, bucket))
    placed = valued.withColumn("__inside", inside).alias("a").join(before.alias("b"), F.expr(same))
    return placed.select("a.*", (F.col("__inside") + F.col("__before")).alias(name)).drop("__amount", "__inside")


def schedule(spark: SparkSession, wanted: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The slots: slot, source, rank (of the slot among its source's).

    wanted: rows (source, target). A slot's point is its number times the golden ratio, modulo one,
    kept as an integer of 31 bits; a longer schedule runs through all the points again. Points meet the sources' spans through cells of the unit interval.
    """
    shares = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(Window.partitionBy())
    spans = wanted.filter("target > 0").select(
        "source",
        ((F.sum("target").over(shares.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("target")) / total).alias("low"),
        (F.sum("target").over(shares.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / total).alias("high"),
        F.sum("target").over(Window.partitionBy()).alias("total"),
    )
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    n = spans.agg(F.ceil(F.max("total") / block_tokens)).first()[0] or 0
    point = F.expr(f"((id & {SPAN - 1}L) * {GOLDEN}L) & {SPAN - 1}L") / float(SPAN)
    slots = spark.range(int(n)).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    dealt = slots.join(spans, "cell").filter("point >= low AND point < high").select("slot", "source", F.floor(F.col("slot") / RUN).alias("run"))
    return _running(dealt, ["source"], "run", ["slot"], F.lit(1).cast("long"), "rank").select("slot", "source", "rank")


def _key(id_: Column) -> Column:
    """60 bits of a keyed hash that other engines have, too."""
    named = F.concat(F.lit(f"{SEED}|"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(F.encode(named, "UTF-8")), 1, 15), 16, 10).cast("long")


def _bucket(key: str) -> Column:
    """The part of the shuffled order that a key falls into."""
    return F.pmod(F.shiftright(key, 40), F.lit(BUCKETS))


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents without their texts, kept in the checkpoint folder: what the rest of the work reads."""
    return cut(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            sizes(df, text_col).alias("size"),
            _key(F.col(id_col)).alias("key"),
        ).withColumn("bucket", _bucket("key"))
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The sized documents with source_size and target, and the pieces of the mix.

    A piece is (slot, source, doc_id, repeat, first_word, n_words): the words of one document, in the
    repeat-th reading of its source, that one slot takes.
    """
    spark = df.sparkSession
    docs = sized(df, id_col, text_col, source_col)
    wanted = cut(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))))
    known = _beside(docs.withColumn("of", F.col("source")), wanted).select(*(f"d.{c}" for c in docs.columns), "e.source_size", "e.target")
    slots = schedule(spark, wanted, block_tokens)
    laid = _running(known.filter("size > 0"), ["source"], "bucket", ["key", "doc_id", "size"], F.col("size"), "place")
    read = laid.withColumn("repeat", F.explode(F.array(*(F.lit(k) for k in range(PASSES))))).withColumn("start", F.col("place") + F.col("repeat") * F.col("source_size"))
    cuts = read.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("size") - 1) / block_tokens))))
    first = F.greatest(F.col("c.start"), F.col("c.block") * block_tokens)
    last = F.least(F.col("c.start") + F.col("c.size"), (F.col("c.block") + 1) * block_tokens)
    pieces = (
        cuts.alias("c")
        .join(slots.alias("s"), F.expr("c.source <=> s.source AND c.block = s.rank"))
        .select("s.slot", "c.source", "c.doc_id", "c.key", "c.size", "c.repeat", (first - F.col("c.start")).alias("first_word"), (last - first).alias("n_words"))
    )
    return known, pieces


def taken(known: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; equal rows share what was taken evenly."""
    per_doc = pieces.groupBy("source", "doc_id", "size").agg(F.sum("n_words").alias("taken"))
    same = known.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    joined = (
        same.alias("d")
        .join(per_doc.alias("t"), F.expr("d.source <=> t.source AND d.doc_id <=> t.doc_id AND d.size = t.size"), "left")
        .select("d.*", F.coalesce("t.taken", F.lit(0)).alias("all"))
    )
    copies = joined.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    even = F.expr("all div n") + F.when(F.col("k") <= F.expr("all % n"), 1).otherwise(0)
    return copies.select("source", "doc_id", "size", "source_size", "target", even.cast("long").alias("taken"))


def _beside(held: DataFrame, ends: DataFrame) -> DataFrame:
    """Each document with the row of its source: broadcast where those rows are few, which is checked, else by a join in which a
    source's documents are dealt out by a salt."""
    n, names = ends.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    if n * ROW_BYTES + names <= BROADCAST_BYTES:
        return held.alias("d").join(F.broadcast(ends).alias("e"), F.expr("d.of <=> e.source"))
    dealt = held.withColumn("salt", F.pmod("key", F.lit(SALTS)))
    every = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.alias("d").join(every.alias("e"), F.expr("d.of <=> e.source AND d.salt = e.salt"))


def resample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with df's own columns: one row for each reading of its source in which the mix takes words of it.

    A document at a block's edge stays whole, so a source's words exceed its target by less than one
    document and one block. What a reading takes of a source are the first documents in the source's shuffled order, so one
    place in that order for each source and reading tells all of them, and no text is shuffled: texts meet a table
    of one narrow row for each source.
    """
    _, pieces = mix(df, id_col, text_col, source_col)
    place = lambda id_: F.struct(_bucket("key").alias("bucket"), F.col("key").alias("key"), F.col(id_).alias("id"), F.col("size").alias("size"))
    last = [F.max(F.when(F.col("repeat") == k, place("doc_id"))).alias(f"last{k}") for k in range(PASSES)]
    ends = cut(pieces.groupBy("source").agg(*last))
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{source_col}`").alias("of"), F.col(f"`{id_col}`").alias("id"), sizes(df, text_col).alias("size"), _key(F.col(f"`{id_col}`")).alias("key"))
    met = _beside(held, ends).withColumn("place", place("id"))
    times = sum((F.when(F.col("place") <= F.col(f"last{k}"), 1).otherwise(0) for k in range(PASSES)), F.lit(0))
    repeated = met.filter("size > 0").withColumn("times", times).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return repeated.select(*(F.col("row").getField(c).alias(c) for c in df.columns))
