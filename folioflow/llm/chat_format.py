"""Chat formatting: multi-party perspective rotation.

Every participant of a conversation is in turn the assistant: the whole dialogue is rendered
with that speaker's turns as assistant turns, everybody else's as turns of named users, and a
mask that trains on the assistant's turns alone.

``rotate_whole`` gives rows for each perspective of a conversation. A turn is in ``part`` k if from k to k + 1 times
``whole_bytes`` of the conversation's texts and headers come before it, so one of up to ``whole_bytes`` has part 0 alone; parts are contiguous
ranges of its turns in order, whose texts one after the other are the whole rendering, and whose
mask starts count from the beginning of the whole. Ranges of longer conversations are cut from a global sort, so neither
a long conversation nor a turn number that repeats is gathered into one task.

Edge cases: a null role is the participant ``unknown``; a null text is an empty turn; a null turn
number sorts first; equal turn numbers are ordered by role, then text; repeated
rows are repeated turns; system turns are shown to everybody and nobody's perspective unless
only system turns exist, when nothing is rendered; very long texts are turns like any other, after one of more than
whole_bytes a part's number is left out; of the input's columns only the four named are read; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut

#: A longer conversation comes in ranges; each turn counts with its headers. Turns that one step of the mask's sum goes over.
WHOLE_BYTES, TURN_BYTES, STEP_TURNS = 4 << 20, 64, 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _said(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def _pieces() -> Column:
    """Header, body and whether it's trained on, for each of turns, as perspective sees it."""
    return F.transform(
        "turns",
        lambda t: F.struct(
            F.when(t["speaker"] == F.col("perspective"), F.lit(f"{OPEN}assistant\n"))
            .when(t["speaker"] == "system", F.lit(f"{OPEN}system\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), t["speaker"], F.lit("\n")))
            .alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            (t["speaker"] == F.col("perspective")).alias("train"),
        ),
    )


def _mask(start: Column) -> Column:
    """The spans of pieces, the first of which starts at start: steps of some turns, so that arrays grow by a step at most."""
    length = lambda p: F.length(p["head"]) + F.length(p["body"])
    step = lambda k: F.slice("pieces", k * STEP_TURNS + 1, STEP_TURNS)
    steps = F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / STEP_TURNS).cast("int"))
    none = F.array().cast("array<struct<start:bigint,length:int,train:boolean>>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    local = F.transform(
        steps,
        lambda k: F.aggregate(
            step(k),
            zero,
            lambda a, p: F.struct(
                (a["at"] + length(p)).alias("at"),
                F.concat(
                    a["spans"],
                    F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"), p["train"].alias("train"))),
                ).alias("spans"),
            ),
        ),
    )
    moved = lambda all_, s, k: F.transform(
        s["spans"],
        lambda m: F.struct((m["start"] + start + F.aggregate(F.slice(all_, F.lit(1), k), F.lit(0).cast("long"), lambda n, e: n + e["at"])).alias("start"), m["length"].alias("length"), m["train"].alias("train")),
    )
    return F.flatten(F.flatten(F.transform(F.array(local), lambda all_: F.transform(all_, lambda s, k: moved(all_, s, k)))))


def rotate_whole(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """Columns: conv_id, part, split, perspective, n_turns, n_trained, text, mask.

    mask: for each turn a struct (start, length, train), in characters of the rendered text;
    start and length span the turn's content and its end mark, the header is never trained on.
    part: how many times whole_bytes come before its turns; split is always 0.
    """
    said = _said(turns, conv_col, turn_col, role_col, text_col)
    weight = F.octet_length("text") + F.octet_length("speaker") + TURN_BYTES
    long_ones = said.groupBy("conv_id").agg(F.sum(weight).alias("n")).filter(F.col("n") > whole_bytes).select("conv_id")
    speakers = said.filter(F.col("speaker") != "system").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    gathered = F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns")
    zero = F.lit(0).cast("long")

    def seen(ranges: DataFrame) -> DataFrame:
        return ranges.alias("s").join(speakers.alias("p"), F.expr("s.conv_id <=> p.conv_id")).select("s.*", "perspective").withColumn("pieces", _pieces())

    def rendered(rows: DataFrame) -> DataFrame:
        return rows.select(
            "conv_id",
            "part",
            zero.alias("split"),
            "perspective",
            F.size("pieces").cast("long").alias("n_turns"),
            F.size(F.filter("pieces", lambda p: p["train"])).cast("long").alias("n_trained"),
            F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
            _mask(F.col("before")).alias("mask"),
        )

    if long_ones.isEmpty():
        return rendered(seen(said.groupBy("conv_id").agg(gathered).withColumns({"part": zero, "before": zero})))
    long_ones = cut(long_ones)
    is_long = F.expr("s.conv_id <=> l.conv_id")
    short = said.alias("s").join(long_ones.alias("l"), is_long, "left_anti").groupBy("conv_id").agg(gathered)
    # Rows that are equal in all else are told apart by an id, so that they don't all go to one range.
    order = ("turn", "speaker", "text", "id")
    sorted_ = said.withColumn("id", F.monotonically_increasing_id()).alias("s").join(long_ones.alias("l"), is_long, "left_semi").repartitionByRange("conv_id", *order)
    placed = cut(sorted_.withColumn("task", F.spark_partition_id()))
    # What comes before a turn: the tasks before its own, one row for each, and its own task's turns before it.
    sums = placed.groupBy("conv_id", "task").agg(F.sum(weight).alias("n"))
    tasks = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("conv_id", "task", F.coalesce(F.sum("n").over(tasks), zero).alias("base"))
    running = Window.partitionBy("conv_id", "task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    based = placed.withColumn("own", F.coalesce(F.sum(weight).over(running), zero)).alias("s").join(bases.alias("b"), F.expr("s.conv_id <=> b.conv_id AND s.task = b.task"))
    numbered = based.select("s.conv_id", "s.turn", "s.speaker", "s.text", F.floor((F.col("base") + F.col("own")) / whole_bytes).cast("long").alias("part"))
    units = cut(numbered.groupBy("conv_id", "part").agg(gathered))
    # One narrow row for each range and perspective: its length, summed over the ranges before it.
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    length = F.aggregate("pieces", zero, lambda n, p: n + F.length(p["head"]) + F.length(p["body"]))
    offsets = seen(units).select("conv_id", "part", "perspective", length.alias("length")).withColumn("before", F.coalesce(F.sum("length").over(earlier), zero))
    same = "u.conv_id <=> o.conv_id AND u.part = o.part AND u.perspective = o.perspective"
    ranges = seen(units).alias("u").join(offsets.alias("o"), F.expr(same)).select("u.*", "o.before")
    return rendered(seen(short.withColumns({"part": zero, "before": zero}))).unionByName(rendered(ranges))
