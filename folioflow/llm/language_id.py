"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes, A-Z lower-cased, are cut into windows of a fixed length that cover all of
it. Bytes are embedded; filters of widths 2, 3 and 4 pass over each window; their ReLU responses are
max-pooled over the window; a softmax gives the languages. A text's score is the mean of its
windows' probabilities, each weighted by its bytes.

When applied, filters are folded with the embedding into two tables over pairs of bytes, so that
a response is the sum of two rows, whatever the width.

Training takes a fixed sample of at most ``max_docs`` labelled documents and, of all windows of their whole texts, at most
``max_windows``: each text's windows are shuffled by a hash, and all first ones are taken before any second one, and so on.
Nothing but text and labels enters it.

Edge cases: a null text or one without a letter is ``und`` with score 0; short texts fill one
window up with spaces; very long texts are many windows, a bounded number at a time; repeated rows
give repeated results; with no labelled rows every text is ``und``; an empty table gives an empty result; of
predict's input only the id, the text and the columns in keep are read, whatever the others are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_sample
from folioflow.session import ship

WINDOW = 160
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBED = 8
CHUNK = 400
OUT_ROWS = 1000
MAX_DOCS = 3000
MAX_WINDOWS = 12_000
UNKNOWN = "und"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class ByteCnn:
    """embed: (256, d). filters: for each width (width, d, n). bias: (widths * n). out: (widths * n, languages)."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to the first two and to the last two bytes of a filter's place, by pair of bytes."""
        taps = np.zeros((4, 256, len(self.bias)), dtype=np.float32)
        at = 0
        for f in self.filters:
            for j in range(f.shape[0]):
                taps[j, :, at : at + f.shape[2]] = self.embed @ f[j]
            at += f.shape[2]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, -1)
        return pair(taps[0], taps[1]) + self.bias.astype(np.float32), pair(taps[2], taps[3])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 128, seed: int = 5) -> ByteCnn:
    """Adam on cross-entropy; the gradient of max pooling goes to each filter's best place alone."""
    rng = np.random.default_rng(seed)
    shapes = {"embed": (256, EMBED), **{f"w{w}": (w, EMBED, FILTERS) for w in WIDTHS}, "bias": (len(WIDTHS) * FILTERS,), "out": (len(WIDTHS) * FILTERS, len(languages)), "out_bias": (len(languages),)}
    p = {k: rng.normal(0, 0.0 if "bias" in k else 0.3, s) for k, s in shapes.items()}
    m, v = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for first in range(0, len(order), batch):
            some = order[first : first + batch]
            x, y = windows[some], labels[some]
            n = len(some)
            e = p["embed"][x]
            pooled, places = [], []
            for i, w in enumerate(WIDTHS):
                r = sum(e[:, j : WINDOW - w + 1 + j] @ p[f"w{w}"][j] for j in range(w)) + p["bias"][i * FILTERS : (i + 1) * FILTERS]
                best = r.argmax(axis=1)
                places.append(best)
                pooled.append(np.take_along_axis(r, best[:, None, :], axis=1)[:, 0])
            h = np.concatenate(pooled, axis=1)
            active = np.maximum(h, 0)
            prob = _softmax(active @ p["out"] + p["out_bias"])
            d = prob.copy()
            d[np.arange(n), y] -= 1
            d /= n
            g = {k: np.zeros(s) for k, s in shapes.items()}
            g["out"], g["out_bias"] = active.T @ d, d.sum(axis=0)
            dh = (d @ p["out"].T) * (h > 0)
            g["bias"] = dh.sum(axis=0)
            for i, w in enumerate(WIDTHS):
                dw = dh[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    at = x[np.arange(n)[:, None], places[i] + j]
                    g[f"w{w}"][j] = np.einsum("nfd,nf->df", p["embed"][at], dw)
                    np.add.at(g["embed"], at.ravel(), (dw[:, :, None] * p[f"w{w}"][j].T[None]).reshape(-1, EMBED))
            step += 1
            rate = 0.01 * (1 - epoch / (epochs + 1))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(languages, p["embed"], [p[f"w{w}"] for w in WIDTHS], p["bias"], p["out"], p["out_bias"])


def _cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows over all the bytes, the last one filled up with spaces, and the bytes in each."""
    n = max(1, -(-len(data) // WINDOW))
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - WINDOW * (n - 1)
    return LOWER[np.frombuffer(data.ljust(n * WINDOW), dtype=np.uint8)].reshape(n, WINDOW), sizes


def fit(
    labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS
) -> ByteCnn | None:
    """Trains on a bounded sample of the labelled rows: at most max_windows windows of at most max_docs texts reach the driver."""
    ship(labelled.sparkSession)
    named = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{text_col}`").alias("text"))
    rows = bounded_sample(named.filter("label IS NOT NULL"), max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, label, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                windows = [w.tobytes() for w in _cut(raw)[0]]
                order = sorted(range(len(windows)), key=lambda j: (zlib.crc32(b"%d %d" % (j, k)), j))
                # More than max_windows of one text are never taken.
                for begin in range(0, min(len(order), max_windows), OUT_ROWS):
                    some = order[begin : min(begin + OUT_ROWS, max_windows)]
                    ranks = np.arange(begin, begin + len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array([k] * len(some), pa.int64()), pa.array([label] * len(some), pa.string()), pa.array([windows[j] for j in some], pa.binary())], names=["rank", "h", "label", "w"])

    texts = rows.filter(F.col("text").rlike(r"\p{L}")).select(F.xxhash64("id"), "label", F.encode("text", "UTF-8"))
    windows = texts.mapInArrow(run, "rank long, h long, label string, w binary").orderBy("rank", "h", "label", "w").limit(max_windows)
    got = windows.toPandas().sort_values(["h", "label", "w"])
    if got.empty:
        return None
    languages = sorted(got["label"].unique())
    windows = np.frombuffer(b"".join(got["w"]), dtype=np.uint8).reshape(-1, WINDOW)
    return train(windows, np.searchsorted(languages, got["label"].to_numpy(dtype=str)), languages)


def predict(df: DataFrame, model: ByteCnn | None, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, lang_pred and score."""
    ship(df.sparkSession)
    names = [id_col, *keep]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        first, second = net.tables() if net else (None, None)
        for whole in batches:
            for begin in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(begin, OUT_ROWS)
                raw = batch.column(len(names)).to_pylist()
                best, score = [UNKNOWN] * len(raw), np.zeros(len(raw))
                total, weight = np.zeros((len(raw), len(net.languages) if net else 1)), np.zeros(len(raw))
                held: list[tuple[np.ndarray, np.ndarray, int]] = []
                count = 0

                def flush() -> None:
                    if held:
                        _add(net, first, second, held, total, weight)

                for k, data in enumerate(raw if net else []):
                    if data is None:
                        continue
                    windows, sizes = _cut(data)
                    for at in range(0, len(windows), CHUNK):
                        held.append((windows[at : at + CHUNK], sizes[at : at + CHUNK], k))
                        count += len(held[-1][0])
                        if count >= CHUNK:
                            flush()
                            held, count = [], 0
                flush()
                for k in np.flatnonzero(weight):
                    p = total[k] / weight[k]
                    best[k], score[k] = net.languages[int(p.argmax())], float(min(1.0, p.max()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    with_letters = F.when(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.encode(F.col(f"`{text_col}`"), "UTF-8"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return df.select(*names, with_letters.alias("__raw")).mapInArrow(run, f"{schema}, lang_pred string, score double")


def _add(net: ByteCnn, first: np.ndarray, second: np.ndarray, held: list[tuple[np.ndarray, np.ndarray, int]], total: np.ndarray, weight: np.ndarray) -> None:
    """Adds the windows' probabilities, weighted by their bytes, to their texts' totals."""
    x = np.concatenate([h[0] for h in held])
    sizes = np.concatenate([h[1] for h in held])
    owner = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
    pairs = x[:, :-1].astype(np.int64) << 8 | x[:, 1:]
    inner = WINDOW - max(WIDTHS) + 1
    pooled = (first[pairs[:, :inner]] + second[pairs[:, 2 : inner + 2]]).max(axis=1)
    # The last places of the narrower filters, where a wide one no longer fits.
    for i, w in enumerate(WIDTHS):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        for at in range(inner, WINDOW - w + 1):
            tail = second[x[:, at + 2].astype(np.int64) << 8][:, part] if w > 2 else 0
            np.maximum(pooled[:, part], first[pairs[:, at]][:, part] + tail, out=pooled[:, part])
    prob = _softmax(np.maximum(pooled, 0) @ net.out + net.out_bias)
    np.add.at(total, owner, prob * sizes[:, None])
    np.add.at(weight, owner, sizes)
