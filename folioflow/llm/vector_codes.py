"""Vector codes: product codebooks refined in rounds, nearest entries found by a kd-tree for each codebook.

A vector's components become integers, floor(SCALE * x), and are cut into equal consecutive parts; each part position has a
codebook of its own. A round broadcasts one kd-tree for each codebook (parts * entries * width integers, whatever the
number of vectors), every task finds its parts' nearest entries and adds up, for each entry, how many parts chose it and
their components; these integer sums, at most parts * entries rows of a task, are added by Spark, and an entry becomes
their floored mean. All arithmetic is on integers, so results don't depend on how rows are dealt.

The search is branch and bound for a whole batch at once: each point first goes down to the leaf whose side of every cut it
lies on, which gives a first distance; then every node is visited once, with those points whose distance to the node's
box is at most their best. Boxes at exactly that distance are visited too, so that of equally near entries the lowest
index is found.

Edge cases: vectors that are null or hold a null, NaN or infinite component are dropped; a first codebook has as many entries
as there are different ids, up to ENTRIES, null last; of several vectors of one id the smallest is its entry, and all of them are
coded; repeated rows give repeated results; null labels share one sum; an empty table gives an empty result; other columns
aren't read. Vectors of different lengths, or of a length that isn't a multiple of the parts, and components
beyond LIMIT after scaling (where squared distances would leave 64 bits) raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import cut, tidy
from folioflow.session import ship

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries of a leaf.
LEAF = 4
#: Largest size of a scaled component.
LIMIT = 1 << 26
#: Vectors searched at once.
ROWS = 8192
#: Sums of labels are broadcast where they and their labels are at most so many bytes, else joined with their rows dealt by a salt.
BROADCAST_BYTES = 8 << 20
SALTS = 64


@dataclass
class Node:
    """A box of entries; a leaf has members, an inner node a cut and two children."""

    low: np.ndarray
    high: np.ndarray
    members: np.ndarray | None = None
    axis: int = 0
    at: int = 0
    children: tuple[int, int] = (0, 0)


class KdTree:
    """entries: (n, width) integers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        self.nodes: list[Node] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        points, place = self.entries[members], len(self.nodes)
        node = Node(points.min(axis=0), points.max(axis=0))
        self.nodes.append(node)
        if len(members) <= LEAF:
            node.members = np.sort(members)
            return place
        node.axis = int((node.high - node.low).argmax())
        ranked = members[np.argsort(points[:, node.axis], kind="stable")]
        half = len(ranked) // 2
        node.at = int(self.entries[ranked[half], node.axis])
        node.children = (self._grow(ranked[:half]), self._grow(ranked[half:]))
        return place

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For points, given as (width, n), the index of the nearest entry and its squared distance; the lower index wins ties."""
        n = points.shape[1]
        best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)

        def scan(node: Node, rows: np.ndarray) -> None:
            here = points[:, rows]
            for e in node.members:
                gone = here - self.entries[e][:, None]
                distance = (gone * gone).sum(axis=0)
                now, so_far = best[rows], index[rows]
                closer = (distance < now) | ((distance == now) & (e < so_far))
                best[rows] = np.where(closer, distance, now)
                index[rows] = np.where(closer, e, so_far)

        def descend(place: int, rows: np.ndarray) -> None:
            node = self.nodes[place]
            if not len(rows):
                return
            if node.members is not None:
                scan(node, rows)
                return
            left = points[node.axis, rows] < node.at
            descend(node.children[0], rows[left])
            descend(node.children[1], rows[~left])

        def visit(place: int, rows: np.ndarray) -> None:
            node = self.nodes[place]
            here = points[:, rows]
            gone = np.maximum(np.maximum(node.low[:, None] - here, here - node.high[:, None]), 0)
            rows = rows[(gone * gone).sum(axis=0) <= best[rows]]
            if not len(rows):
                return
            if node.members is not None:
                scan(node, rows)
                return
            for child in node.children:
                visit(child, rows)

        everyone = np.arange(n)
        descend(0, everyone)
        visit(0, everyone)
        return index, best


@dataclass
class Codebooks:
    """entries: (parts, entries, width) integers."""

    entries: np.ndarray
    trees: list[KdTree] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        self.trees = [KdTree(book) for book in self.entries]

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimals joined by commas; lowercase hex."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, wrong)


def kept(df: DataFrame, vector_col: str, *cols: str) -> DataFrame:
    """The columns and __vector of the rows whose vector counts."""
    named = df.select(*(F.col(f"`{c}`") for c in cols), F.col(f"`{vector_col}`").cast("array<double>").alias("__vector"))
    return named.filter(_finite(F.col("__vector")))


def _scaled(values: np.ndarray) -> np.ndarray:
    whole = np.floor(values * SCALE)
    if whole.size and np.abs(whole).max() > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT // SCALE}")
    return whole.astype(np.int64)


def _points(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Vectors of a batch as (parts, width, n) integers."""
    if column.null_count or not bool((np.diff(column.offsets.to_numpy()) == width * parts).all()):
        raise ValueError(f"a vector hasn't {width * parts} components")
    return np.ascontiguousarray(_scaled(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, parts, width).transpose(1, 2, 0))


def first_codebooks(rows: DataFrame, id_col: str, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids. At most that many vectors reach the driver."""
    ids = [r[0] for r in rows.select(F.col(f"`{id_col}`").alias("id")).distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    if not ids:
        return None
    at = F.col(f"`{id_col}`")
    wanted = at.isin([i for i in ids if i is not None]) | (at.isNull() if None in ids else F.lit(False))
    found = {r[0]: r[1] for r in rows.filter(wanted).groupBy(at.alias("id")).agg(F.min("__vector").alias("vector")).collect()}
    vectors = [found[i] for i in ids]
    if len({len(v) for v in vectors}) > 1 or not vectors[0] or len(vectors[0]) % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return Codebooks(_scaled(np.array(vectors, dtype=np.float64)).reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def refine(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts that are nearest to it; an entry without any stays."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.entries.shape
    names = ["n", *(f"s{j}" for j in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value.trees
        sums = np.zeros((len(names), parts, entries), dtype=np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                points = _points(whole.slice(begin, ROWS).column(0), width, parts)
                for p in range(parts):
                    index, _ = trees[p].nearest(points[p])
                    sums[0, p] += np.bincount(index, minlength=entries)
                    for j in range(width):
                        # Whole numbers below 2 ** 53 in doubles, so the sum of a batch is exact.
                        sums[j + 1, p] += np.bincount(index, weights=points[p, j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"part": p, "entry": e, **{name: sums[k, p, e] for k, name in enumerate(names)}})

    schema = "part long, entry long, " + ", ".join(f"{n} long" for n in names)
    added = rows.select("__vector").mapInArrow(tidy(run), schema).groupBy("part", "entry").agg(*(F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names))
    new = books.entries.copy()
    for row in added.collect():
        new[row["part"], row["entry"]] = [int(row[n]) // int(row["n"]) for n in names[1:]]
    shared.unpersist()
    return Codebooks(new)


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all vectors; None if there are none. entries: at most 256, for two hex digits each."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    ship(df.sparkSession)
    rows = kept(df, vector_col, id_col)
    books = first_codebooks(rows, id_col, parts, entries)
    for _ in range(rounds if books else 0):
        books = refine(rows, books)
    return books


def encode(df: DataFrame, books: Codebooks, vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns in keep, code (two hex digits for each part) and error (squared distances, summed over the parts)."""
    ship(df.sparkSession)
    rows = kept(df, vector_col, *keep)
    shared = df.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.entries.shape
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value.trees
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                points = _points(batch.column(len(keep)), width, parts)
                found = [trees[p].nearest(points[p]) for p in range(parts)]
                text = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=[*keep, "code", "error"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "code string", "error long"])
    return rows.toDF(*(f"c{k}" for k in range(len(keep) + 1))).mapInArrow(tidy(run), schema)  # mapInArrow can't resolve names with dots


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Coded rows with label_error, the error summed over equal labels; null labels together.

    Sums are made before the shuffle. Where their size, which is asked first, is small they are broadcast; else the rows
    of a label are dealt by a salt that its sum is repeated for. coded should be a checkpoint or a table: it is read twice.
    """
    label = F.col(f"`{label_col}`")
    sums = cut(coded.groupBy(label.alias("__label")).agg(F.sum("error").alias("label_error")))
    n, size = sums.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("__label").cast("string"))), F.lit(0))).first()
    if n * 64 + size <= BROADCAST_BYTES:
        return coded.join(F.broadcast(sums), label.eqNullSafe(F.col("__label"))).drop("__label")
    dealt = coded.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    every = sums.withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(every, label.eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__to"))).drop("__label", "__salt", "__to")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id_col, label_col, code, error, label_error and codebooks_sha256 of every vector that counts."""
    books = fit(df, id_col, vector_col, parts, entries, rounds)
    if books is None:
        none = df.limit(0).select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`"))
        return none.selectExpr("*", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    coded = cut(encode(df, books, vector_col, (id_col, label_col)))
    return with_label_error(coded, label_col).withColumn("codebooks_sha256", F.lit(books.sha256()))
