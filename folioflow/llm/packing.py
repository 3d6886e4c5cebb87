"""Best-fit packing of documents' tokens into sequences, by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most the capacity. Pieces of one length can stand for each other, so a packing is told by its
patterns: for each multiset of lengths that shares a sequence, how many sequences have it. Patterns are few (their number grows with the
capacity, not with the documents), while their multiplicities count any number of documents; a count for each length is all that
leaves the documents' tasks. What follows is spread out again: pieces get their rank among those of their length, from counts of partitions,
and a rank tells the sequence and the place in it.

Each island holds a population of packings. A crossover takes whole sequences from the better-filled ones of one parent, keeps
of the other parent the sequences that need no document a second time, and puts the documents of the others, displaced, by best fit:
longest first, each into the fullest sequence that still has room. Mutation dissolves sequences that are badly filled and some others.
Packings are ranked by the number of sequences, then by the sum of squared fills. Islands are rows of a table, an epoch is a grouped step
over it, and between epochs each island's elite goes to its neighbour as well. An island whose best reaches a lower
bound rests.

Edge cases: a null or empty text is the end id alone; very long texts are encoded in spans that end before a word and are cut into full
pieces behind a shorter first one; repeated rows are packed once each; pieces of equal length are dealt in the order of their ids; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut, tidy
from folioflow.session import ship

CAPACITY = 1024
#: The end id; it closes each document.
END = 2
ISLANDS = 6
EPOCHS = 3
POPULATION = 6
CHILDREN = 8
ELITE = 2
SEED = 12
#: Characters of a text that are encoded at once.
SPAN = 1 << 20
#: How byte-level BPE cuts a text before it merges (fixed value of that kind of tokenizer).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before a space that something follows, pre-tokens always end.
BREAK = re.compile(r" (?=\S)")

#: Lengths with their numbers, longest first; how many sequences hold exactly these.
Pattern = tuple[tuple[int, int], ...]
Packing = dict[Pattern, int]


# -- token ids ---------------------------------------------------------------------------


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_encoder(description: str):
    """An encoder of the byte-level BPE that a tokenizer's JSON describes, whose ids rank its merges."""
    import tiktoken

    described = json.loads(description)
    letters = _bytes_of_letters()
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): k for token, k in described["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)


def token_bytes(encoder, text: str, end: int = END) -> bytes:
    """A text's ids and the end id as little-endian 32-bit numbers. Strings of special tokens become their ids."""
    special, out, start = encoder.special_tokens_set, [], 0
    while start < len(text):
        after = BREAK.search(text, start + SPAN) if start + SPAN < len(text) else None
        stop = after.start() if after else len(text)
        some = text[start:stop]
        ids = encoder.encode(some, allowed_special=special) if any(s in some for s in special) else encoder.encode_ordinary(some)
        out.append(np.array(ids, dtype="<u4").tobytes())
        start = stop
    return b"".join(out) + np.array([end], dtype="<u4").tobytes()


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length and ids_crc32 of every piece, with_ids also its ids as little-endian 32-bit numbers.

    tokenizer: path of a byte-level BPE's JSON; its content goes out with the job. All pieces but a document's first are full.
    """
    ship(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    kind = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(shared.value)
        for batch in batches:
            rows, own = [], []
            for k, text in enumerate(batch.column(1)):
                data = token_bytes(encoder, text.as_py())
                n = len(data) // 4
                number = -(-n // capacity)
                ends = [n - capacity * (number - 1 - p) for p in range(number)]
                for p, (start, stop) in enumerate(zip([0, *ends], ends, strict=False)):
                    part = data[4 * start : 4 * stop]
                    own.append(k)
                    rows.append((p, start, stop - start, zlib.crc32(part), part if with_ids else b""))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *columns], names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = texts.mapInArrow(tidy(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out.withColumnRenamed("id", id_col) if with_ids else out.drop("ids").withColumnRenamed("id", id_col)


# -- packings ----------------------------------------------------------------------------


def filled(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def fitness(packing: Packing) -> tuple[int, int]:
    """Smaller is better: the number of sequences, then the squared fills, negative."""
    return sum(packing.values()), -sum(n * filled(p) ** 2 for p, n in packing.items())


def contents(packing: Packing) -> dict[int, int]:
    """How many documents of each length a packing holds."""
    out: dict[int, int] = {}
    for pattern, n in packing.items():
        for length, k in pattern:
            out[length] = out.get(length, 0) + n * k
    return out


def _joined(pattern: Pattern, length: int, n: int) -> Pattern:
    own = dict(pattern)
    own[length] = own.get(length, 0) + n
    return tuple(sorted(own.items(), reverse=True))


def best_fit(packing: Packing, loose: dict[int, int], capacity: int, rng: random.Random | None = None) -> Packing:
    """Puts loose documents, longest first, each into the fullest sequence that has room for it, else into a new one.

    All of one length go at once: after one of them the fullest sequence with room is still the same, until it has none.
    With rng the order of lengths is shaken by up to a tenth.
    """
    rooms: dict[int, Packing] = {}
    gaps: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        gap = capacity - filled(pattern)
        if gap not in rooms:
            rooms[gap] = {}
            insort(gaps, gap)
        rooms[gap][pattern] = rooms[gap].get(pattern, 0) + n

    for pattern, n in packing.items():
        put(pattern, n)
    for length in sorted(loose, key=(lambda x: -x * (1 + rng.random() / 10)) if rng else (lambda x: -x)):
        n = loose[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fits = capacity // length
                whole, rest = divmod(n, fits)
                if whole:
                    put(((length, fits),), whole)
                if rest:
                    put(((length, rest),), 1)
                break
            gap = gaps[at]
            pattern, there = rooms[gap].popitem()
            if not rooms[gap]:
                del rooms[gap], gaps[at]
            fits = gap // length
            whole = min(there, n // fits)
            if whole:
                put(_joined(pattern, length, fits), whole)
                n, there = n - whole * fits, there - whole
            if n and there:
                put(_joined(pattern, length, n), 1)
                n, there = 0, there - 1
            if there:
                put(pattern, there)
    return {pattern: n for some in rooms.values() for pattern, n in some.items()}


def crossover(a: Packing, b: Packing, capacity: int, rng: random.Random) -> Packing:
    """Well-filled sequences of b, those of a that need no document twice, and the displaced documents by best fit."""
    by_gap = sorted(b, key=lambda p: (capacity - filled(p), p))
    child: Packing = {}
    for pattern in by_gap[: max(1, len(by_gap) // 2)]:
        if rng.random() < 0.5:
            child[pattern] = b[pattern] if rng.random() < 0.5 else rng.randint(1, b[pattern])
    free = contents(b)
    for length, n in contents(child).items():
        free[length] -= n
    for pattern in sorted(a, key=lambda p: (capacity - filled(p), p)):
        n = min(a[pattern], *(free[length] // k for length, k in pattern))
        if n:
            child[pattern] = child.get(pattern, 0) + n
            for length, k in pattern:
                free[length] -= n * k
    return best_fit(child, {length: n for length, n in free.items() if n}, capacity)


def mutate(packing: Packing, capacity: int, rng: random.Random) -> Packing:
    """Dissolves the tenth of the patterns that is filled worst and some others, and packs their documents anew."""
    by_gap = sorted(packing, key=lambda p: (filled(p), p))
    worst = len(by_gap) // 10 + 1
    gone = {p: packing[p] if k < worst else rng.randint(1, packing[p]) for k, p in enumerate(by_gap) if k < worst or rng.random() < 0.05}
    stay = {p: n - gone.get(p, 0) for p, n in packing.items() if n > gone.get(p, 0)}
    return best_fit(stay, contents(gone), capacity, rng)


def evolve(population: list[Packing], capacity: int, rng: random.Random, children: int = CHILDREN, size: int = POPULATION) -> list[Packing]:
    """The best of a population and its children, best first. A population that has reached the lower bound stays as it is."""
    least = least_sequences(contents(population[0]), capacity)
    rank = lambda p: (fitness(p), sorted(p.items()))
    population = sorted(population, key=rank)
    for _ in range(children):
        if fitness(population[0])[0] <= least:
            break
        a, b = (min(rng.sample(range(len(population)), min(2, len(population)))) for _ in range(2))
        child = mutate(crossover(population[a], population[b], capacity, rng), capacity, rng)
        if child not in population:
            population = sorted([*population, child], key=rank)[:size]
    return population[:size]


def _written(packing: Packing) -> str:
    return json.dumps(sorted(packing.items(), reverse=True))


def _read(text: str) -> Packing:
    return {tuple((length, k) for length, k in pattern): n for pattern, n in json.loads(text)}


STATE = "island long, place long, sequences long, squares decimal(38,0), packing string"


def _rows(island: int, population: list[Packing]) -> pd.DataFrame:
    ranked = [(island, k, fitness(p)[0], Decimal(fitness(p)[1]), _written(p)) for k, p in enumerate(population)]
    return pd.DataFrame(ranked, columns=["island", "place", "sequences", "squares", "packing"])


def search(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, children: int = CHILDREN, elite: int = ELITE, seed: int = SEED) -> Packing:
    """The best packing that the islands find of so many documents of each length. counts has at most capacity lengths."""
    if not counts:
        return {}
    ship(spark)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First packings: plain best fit, then best fits in shaken orders."""
        for batch in batches:
            for island in batch["id"].tolist():
                rng = random.Random(f"{seed} {island}")
                first = [best_fit({}, counts, capacity), *(best_fit({}, counts, capacity, rng) for _ in range(population - 1))]
                yield _rows(island, sorted(first, key=fitness))

    state = cut(spark.range(0, islands, 1, islands).mapInPandas(settle, STATE))

    def step(epoch: int):
        def evolved(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own = [_read(text) for text in sorted(set(rows["packing"]))]
            return _rows(key[0], evolve(own, capacity, random.Random(f"{seed} {key[0]} {epoch}"), children, population))

        return evolved

    for epoch in range(epochs):
        guests = state.filter(F.col("place") < elite).withColumn("island", (F.col("island") + 1) % islands)
        state = cut(state.unionByName(guests).groupBy("island").applyInPandas(step(epoch), STATE))
    best = state.orderBy("sequences", "squares", "packing").select("packing").first()
    return _read(best["packing"])


# -- places ------------------------------------------------------------------------------


def layout(packing: Packing) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, how many to a sequence), sorted: who comes where, by rank among equal lengths."""
    rows, taken, sequence = [], {}, 0
    for pattern, n in sorted(packing.items(), reverse=True):
        offset = 0
        for length, k in pattern:
            rows.append((length, taken.get(length, 0), sequence, offset, k))
            taken[length] = taken.get(length, 0) + n * k
            offset += length * k
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, id_col: str) -> DataFrame:
    """rank: each piece's place among those of its length. Only counts of partitions are added up over all of them.

    rows: a checkpoint with __part, the partition it was made in; a partition's pieces of one length are numbered in one task.
    """
    counts = rows.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__part", "length").orderBy(F.col(f"`{id_col}`"), "piece", "start", "ids_crc32")
    return rows.join(bases, ["__part", "length"]).withColumn("rank", F.col("__base") + F.row_number().over(own) - 1).drop("__part", "__base")


def place(rows: DataFrame, packing: Packing) -> DataFrame:
    """Ranked pieces with sequence_id and offset."""
    shared = rows.sparkSession.sparkContext.broadcast(layout(packing))
    names = rows.columns
    at_length, at_rank = names.index("length"), names.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (at_length, at_rank))
            row = table[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            columns = [pa.array(row[:, 2] + nth // row[:, 4]), pa.array(row[:, 3] + nth % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(tidy(run), f"{kinds}, sequence_id long, offset long").drop("rank")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, **options: int) -> DataFrame:
    """Every piece with its sequence_id and offset in it. options: those of search."""
    rows = cut(pieces(df, tokenizer, id_col, text_col, capacity, with_ids).withColumn("__part", F.spark_partition_id()))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    packing = search(df.sparkSession, counts, capacity, **options)
    return place(ranked(rows, id_col), packing)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and tokens of each sequence, of pieces packed with_ids: at most the capacity's ids to a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    whole = F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), ""))
    return packed.groupBy("sequence_id").agg(whole.alias("tokens"), F.sum("length").alias("n_tokens"))


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: all tokens over the capacity, and documents of more than half of it need one each."""
    tokens = math.ceil(sum(length * n for length, n in counts.items()) / capacity)
    return max(tokens, sum(n for length, n in counts.items() if 2 * length > capacity))
