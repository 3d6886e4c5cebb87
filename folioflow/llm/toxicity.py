"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A text is a bag of sentences. A sentence's score is a logistic function of the features of the words in it, and a
text is toxic with the probability that at least one sentence is: one less the product of the
sentences' complements. Only documents carry labels; the gradient of that product tells which
sentences to blame, and the scores of single sentences then locate the offending ones.

A word's features are itself and its beginnings, hashed into ``1 << BITS`` places. Over a fixed sample of at most
``max_docs`` labelled documents, the bound on what reaches the driver, Spark counts how many documents have each
place; all places whose share of toxic documents lies far enough above chance get weights, fitted in numpy.

Edge cases: a null or empty text has no sentences and score 0; very long texts are bags of many
sentences; repeated rows give repeated results; repeated labels of a document count as
repeated documents; with no labelled rows, or labels of one kind, every score is 0; an empty table gives an empty
result; of the columns of score's input only the id, the text and those in keep are read, whatever the others are called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_sample
from folioflow.session import ship

MAX_DOCS = 16_000
BITS = 18
#: Lengths of a word's beginnings.
BEGINNINGS = (3, 4, 5, 6, 7)
MIN_DOCS = 4
MIN_Z = 4.0
#: A sentence ends after these, a word is a run of letters.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+|$)")
TERM = re.compile(r"[^\W\d_]+")
OUT_ROWS = 2000
#: Words whose places a worker remembers.
REMEMBERED = 200_000


def lowered(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_places(word: str) -> set[int]:
    """The places of a lower-case word and of its beginnings."""
    own = {word, *(f"^{word[:n]}" for n in BEGINNINGS if n < len(word))}
    return {zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in own}


class Places(dict):
    """For each word its places among those wanted (all if None), found at the first lookup; some words are remembered."""

    def __init__(self, wanted: set[int] | None = None) -> None:
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        own = word_places(word)
        self[word] = found = tuple(own if self.wanted is None else own & self.wanted)
        return found


def bag(text: str, places: Places) -> Iterator[tuple[int, int, set[int]]]:
    """Start, end and places of each sentence of a lowered text that has a word."""
    for match in SENTENCE.finditer(text):
        found = TERM.findall(match.group())
        if found:
            yield match.start(), match.end(), {p for w in set(found) for p in places[w]}


@dataclass
class NoisyOr:
    """weights: of the chosen places. bias: of every sentence."""

    weights: dict[int, float]
    bias: float
    places: Places = field(default_factory=Places, repr=False)

    def __post_init__(self) -> None:
        self.places = Places(set(self.weights))

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def score(self, text: str, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score, and the sentences whose own score reaches least."""
        clean, offending = 0.0, []
        if not self.weights:
            return 0.0, offending
        for start, end, own in bag(lowered(text), self.places):
            p = 1 / (1 + math.exp(-max(-700.0, self.bias + math.fsum(self.weights[k] for k in own))))
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= least:
                offending.append((start, end, p))
        return min(1.0, max(0.0, -math.expm1(clean))), offending


def choose_places(sample: DataFrame) -> list[int]:
    """Places of rows (text, label) whose documents are toxic far more often than chance; all of them that are."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not totals["n"] or not totals["toxic"] or totals["toxic"] == totals["n"]:
        return []
    p = totals["toxic"] / totals["n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents that have each place, added up over a batch."""
        places = Places()
        for batch in batches:
            n, toxic = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.fromiter({p for w in set(TERM.findall(lowered(text))) for p in places[w]}, dtype=np.int64)
                n[own] += 1
                toxic[own] += label
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"place": some, "n": n[some], "toxic": toxic[some]})

    counted = sample.select("text", "label").mapInArrow(count, "place long, n long, toxic long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    return sorted(r["place"] for r in counted.filter((F.col("toxic") >= MIN_DOCS) & (z >= MIN_Z)).select("place").collect())


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> NoisyOr:
    """labels: rows (id_col, label_col in 0, 1); those held out must be gone already. At most max_docs labelled texts are fitted on."""
    ship(documents.sparkSession)
    some = bounded_sample(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna(), max_docs)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    met = texts.join(F.broadcast(some), "id")
    # Ids may repeat among the documents, so what is fitted on is bounded again; a count reads ids alone.
    sample = met if texts.select("id").join(F.broadcast(some), "id").count() <= max_docs else bounded_sample(met, max_docs)
    chosen = choose_places(sample)
    if not chosen:
        return NoisyOr({}, -math.inf)
    wanted = set(chosen)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document the number of its sentences, and the places of those that have any."""
        places = Places(wanted)
        for batch in batches:
            rows = []
            for key, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [sorted(own) for _, _, own in bag(lowered(text), places)]
                hit = [h for h in found if h]
                rows.append((key, label, len(found), np.array([len(h) for h in hit], dtype="<i4").tobytes(), np.array([p for h in hit for p in h], dtype="<i4").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["key", "label", "n", "lengths", "places"])

    keyed = sample.select(F.xxhash64("id").alias("key"), "text", F.col("label").cast("long"))
    got = sorted(map(tuple, keyed.mapInArrow(bags, "key long, label long, n long, lengths binary, places binary").collect()))
    weights, bias = _fit_weights(got, np.array(chosen))
    return NoisyOr(dict(zip(chosen, weights.tolist(), strict=True)), float(bias))


def _fit_weights(bags: list[tuple], chosen: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the likelihood of the documents' labels under noisy-or."""
    lengths = [np.frombuffer(b[3], dtype="<i4") for b in bags]
    owner = np.repeat(np.arange(len(bags)), [len(x) for x in lengths])
    sentence = np.repeat(np.arange(len(owner)), np.concatenate(lengths))
    flat = np.searchsorted(chosen, np.frombuffer(b"".join(b[4] for b in bags), dtype="<i4"))
    y = np.array([b[1] for b in bags], dtype=float)
    plain = np.array([b[2] for b in bags], dtype=float) - np.bincount(owner, minlength=len(bags))
    theta, m, v = np.concatenate((np.zeros(len(chosen)), [-6.0])), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        logits = b + np.bincount(sentence, weights=w[flat], minlength=len(owner))
        p, p0 = 1 / (1 + np.exp(-logits)), 1 / (1 + math.exp(-b))
        clean = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags)) + plain * math.log1p(-p0)
        doc = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d likelihood / d logit of a sentence is p * (y / doc - 1), whatever the other sentences are.
        blame = (y / doc - 1) / len(bags)
        by_sentence = blame[owner] * p
        g = np.append(np.bincount(flat, weights=by_sentence[sentence], minlength=len(chosen)), by_sentence.sum() + (blame * plain).sum() * p0)
        g -= l2 * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], theta[-1]


def score(df: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, score, and the offending sentences as (start, end, score) in characters."""
    ship(df.sparkSession)
    names = [id_col, *keep]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    shared = df.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(begin, OUT_ROWS)
                found = [model.score(t, least) for t in batch.column(len(names)).to_pylist()]
                offending = [[{"start": s, "end": e, "score": p} for s, e, p in f[1]] for f in found]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([f[0] for f in found], pa.float64()), pa.array(offending, spans)], names=[*names, "score", "offending"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    texts = df.select(*(F.col(f"`{c}`") for c in names), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    return texts.mapInArrow(run, f"{schema}, score double, offending array<struct<start:int,end:int,score:double>>")


def is_toxic(score_col: str = "score", threshold: float = 0.5) -> Column:
    return (F.col(score_col) >= threshold).cast("int")
