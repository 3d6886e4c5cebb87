"""SentencePiece encoding and decoding with offsets.

The model file is read for its pieces and its normaliser. Normalisation walks the compiled
character map, a double-array trie, taking the longest prefix at every place, and records for
every byte of the normalised text the byte of the source it came from. Pieces are found by
merging pairs by score, segment by segment, and projected through that record to byte spans of
the source. An unknown character becomes its UTF-8 bytes' pieces.

No piece joins another character to a following space mark, which is checked when the model is
loaded, so the text is cut before each run of marks and each segment's merges are found once
and kept in a bounded cache.

Edge cases: a null text is an empty one; an empty text has the end id alone; a literal space
mark (U+2581) in the text encodes as a space, as in the library; very long segments without
spaces are merged with a heap, in n log n; repeated rows give repeated results; an empty table gives an empty result;
of the input's columns only the id and the text are read, whatever the others are called.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import tidy
from folioflow.session import ship

MARK = "▁"
MARK_BYTES = MARK.encode()
SHORT = 48  # characters of segments that are merged in step with others
GROUP_ROWS = 4000
PAIR_BITS = 20
CACHED_SEGMENTS = 100_000
OUT_ROWS = 200
#: Kinds of pieces and numbers of fields in the model file (fixed values of its public format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 0x7F) << shift
            at += 1
            shift += 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(wire) or varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Numbers(dict):
    """Numbers given to strings in the order of their first lookup; new has those since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = len(self)
        return len(self) - 1


class CharMap:
    """The compiled character map: a double-array trie and the replacements its values point to."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[start:] in the map, and that prefix's length."""
        if not self.units:
            return None
        offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node, found = offset(self.units[0]), None
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[at]:
                break
            node ^= offset(unit)
            if unit & 0x100:
                found = self.units[node] & 0x7FFFFFFF, at + 1 - start
        if found is None:
            return None
        return self.replacements[found[0] : self.replacements.index(b"\0", found[0])], found[1]


class Model:
    """Pieces, scores and normaliser of a model file."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one[1])
                self.scores.append(struct.unpack("<f", one.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only models of the BPE kind with marks in front of words are read")
        self.char_map = CharMap(normaliser.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        if not self.escape:
            raise ValueError("only models that escape spaces are read")
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.end = trainer.get(42, 2)
        self.by_text = {p.decode(): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("models with user-defined or unused pieces aren't read")
        byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [byte[b] for b in range(256)] if len(byte) == 256 else None
        if any(MARK in p.lstrip(MARK) for p in self.by_text):
            raise ValueError("a piece has a space mark after another character")
        shown = {CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        self.surfaces = [shown.get(k, lambda p: p.replace(MARK_BYTES, b" "))(p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._pair_table()
        self._forget()

    # -- normalisation -------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its bytes and its end the source byte; None if every mark stands for one space."""
        if not text:
            return "", None
        if not self.char_map.units and not self.trim and MARK not in text:
            return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK), None
        data = text.encode()
        out, source = bytearray(), []
        at = 0
        after_space = self.trim

        def put(piece: bytes, place: int) -> None:
            piece = piece.replace(b" ", MARK_BYTES)
            out.extend(piece)
            source.extend([place] * len(piece))

        def step(place: int) -> tuple[bytes, int]:
            found = self.char_map.longest(data, place)
            if found:
                return found
            length = 1 + next((n for n, low in ((3, 0xF0), (2, 0xE0), (1, 0xC0)) if data[place] >= low), 0)
            return data[place : place + length], length

        while self.trim and at < len(data) and step(at)[0].strip(b" ") == b"":
            at += step(at)[1]
        if at == len(data):
            return "", np.zeros(1, dtype=np.int64)
        if self.dummy_prefix:
            put(b" ", at)
        while at < len(data):
            piece, length = step(at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece, at)
                after_space = self.trim and piece.endswith(b" ")
            at += length
        while self.trim and out.endswith(MARK_BYTES):
            del out[-len(MARK_BYTES) :]
            at = source[-len(MARK_BYTES)]
            del source[-len(MARK_BYTES) :]
        return out.decode(), np.array([*source, at], dtype=np.int64)

    # -- pieces --------------------------------------------------------------------------

    def _pair_table(self) -> None:
        """Pairs of symbols that make a piece, in an open hash table of arrays; a character that is no piece is its code point plus n."""
        n = self.n = len(self.pieces)
        self.char_ids = np.arange(n, n + 0x110000, dtype=np.int32)
        if self.byte_ids is not None:
            self.char_ids[:128] = self.byte_ids[:128]  # no pair has them, so they stay alone
        for text, k in self.by_text.items():
            if len(text) == 1:
                self.char_ids[ord(text)] = k
        symbol = lambda t: self.by_text.get(t, n + ord(t) if len(t) == 1 else None)
        self.slots = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.made = np.full(1 << PAIR_BITS, -1, dtype=np.int32)
        for text, k in self.by_text.items():
            for cut in range(1, len(text)):
                first, second = symbol(text[:cut]), symbol(text[cut:])
                if first is not None and second is not None:
                    key = np.int64(first << 21 | second)
                    at = int(self._slot(np.array([key]))[0])
                    while self.slots[at] >= 0:
                        at = (at + 1) & ((1 << PAIR_BITS) - 1)
                    self.slots[at], self.made[at] = key, k
        self.rank = np.array([*self.scores, -np.inf])
        self.lengths = np.array([1 if k == BYTE else len(p) for p, k in zip(self.pieces, self.kinds, strict=True)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)

    def _pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = np.where(second >= 0, first << 21 | second, -2)
        at = self._slot(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.made[at], -1)
        more = np.flatnonzero((held != keys) & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << PAIR_BITS) - 1)
            held = self.slots[at[more]]
            hit = held == keys[more]
            out[more[hit]] = self.made[at[more[hit]]]
            more = more[~hit & (held >= 0)]
        return out

    def _merge_group(self, symbols: np.ndarray) -> np.ndarray:
        """Merges in all rows at once, in each row the best pair, the leftmost first among equals, until none is a piece.

        symbols: a row for each segment, filled up with -1; gives the same shape.
        """
        out = np.full_like(symbols, -1)
        rows = np.arange(len(symbols))
        width = symbols.shape[1]
        made = self._pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(-1, width - 1)
        columns = np.arange(width - 1)
        while len(rows):
            rank = self.rank[made]
            j = rank.argmax(axis=1)
            here = np.arange(len(rows))
            live = made[here, j] >= 0
            if not live.all():
                out[rows[~live]] = symbols[~live]
                rows, symbols, made, j = rows[live], symbols[live], made[live], j[live]
                here = here[: len(rows)]
                if not len(rows):
                    break
            symbols[here, j] = made[here, j]
            gone = columns[:-1] >= j[:, None]
            symbols[:, 1:-1] = np.where(gone, symbols[:, 2:], symbols[:, 1:-1])
            symbols[:, -1] = -1
            made[:, :-1] = np.where(gone, made[:, 1:], made[:, :-1])
            made[:, -1] = -1
            made[here, j] = self._pairs(symbols[here, j], symbols[here, j + 1])
            left = np.flatnonzero(j > 0)
            made[left, j[left] - 1] = self._pairs(symbols[left, j[left] - 1], symbols[left, j[left]])
        return out

    def _merge_long(self, segment: str) -> list[int]:
        """The same for one very long segment, by a heap and a linked list, in n log n."""
        parts: list[str | None] = list(segment)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := self.by_text.get(pair := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, pair))

        for i, j in pairwise(range(n)):
            offer(i, j)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [self.by_text[p] if p in self.by_text else int(self.char_ids[ord(p)]) for p in parts if p is not None]

    def _symbols(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of many segments, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        chars = self.char_ids[np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        found: list[np.ndarray] = []
        counts = np.zeros(len(segments), dtype=np.int64)
        which: list[np.ndarray] = []
        low = 0
        for width in (6, 10, 14, 20, 32, SHORT):
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(group), GROUP_ROWS):
                some = group[at : at + GROUP_ROWS]
                grid = np.arange(width)[None, :]
                inside = grid < sizes[some][:, None]
                spots = np.minimum(starts[some][:, None] + grid, len(chars) - 1)
                merged = self._merge_group(np.where(inside, chars[spots], -1))
                kept = merged >= 0
                counts[some] = kept.sum(axis=1)
                found.append(merged[kept])
                which.append(some)
        for k in np.flatnonzero(sizes > SHORT):
            found.append(np.array(self._merge_long(segments[k]), dtype=np.int64))
            counts[k] = len(found[-1])
            which.append(np.array([k]))
        if not which:
            return np.zeros(0, dtype=np.int64), counts
        order = np.concatenate(which)
        begins = np.zeros(len(segments), dtype=np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return _gather(np.concatenate(found), begins, counts), counts

    def _learn(self, segments: list[str]) -> None:
        """Puts new segments' ids, and the normalised bytes that each covers, into the pool."""
        symbols, counts = self._symbols(segments)
        plain = symbols < self.n
        ids, covered = symbols, np.where(plain, self.lengths[np.where(plain, symbols, 0)], 0)
        if not plain.all():  # characters of several bytes that no piece has
            owner = np.repeat(np.arange(len(segments)), counts)
            out_ids, out_covered, out_owner, at = [], [], [], 0
            for k in np.flatnonzero(~plain):
                data = chr(int(symbols[k]) - self.n).encode()
                own = [self.byte_ids[b] for b in data] if self.byte_ids is not None else [self.unknown]
                out_ids += [ids[at:k], np.array(own)]
                out_covered += [covered[at:k], np.array([*[0] * (len(own) - 1), len(data)])]
                out_owner += [owner[at:k], np.full(len(own), owner[k])]
                at = k + 1
            ids, covered, owner = (np.concatenate([*x, y[at:]]) for x, y in ((out_ids, ids), (out_covered, covered), (out_owner, owner)))
            counts = np.bincount(owner, minlength=len(segments))
        begin = len(self.pool_ids)
        self.pool_begins = np.concatenate((self.pool_begins, begin + np.cumsum(counts) - counts))
        self.pool_counts = np.concatenate((self.pool_counts, counts))
        self.pool_ids = np.concatenate((self.pool_ids, ids.astype(np.int32)))
        self.pool_covered = np.concatenate((self.pool_covered, covered.astype(np.int32)))

    def _forget(self) -> None:
        self.known = Numbers()
        self.pool_begins = self.pool_counts = np.zeros(0, dtype=np.int64)
        self.pool_ids = self.pool_covered = np.zeros(0, dtype=np.int32)

    def encode_many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids without the end id, and the first and last source byte (exclusive) of each."""
        if len(self.known) > CACHED_SEGMENTS or len(self.pool_ids) > 8 * CACHED_SEGMENTS:
            self._forget()
        normalised = [self.normalise(t) for t in texts]
        cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        segments = [cut(n) for n, _ in normalised]
        number = self.known.__getitem__
        places = [np.fromiter(map(number, own), dtype=np.int64, count=len(own)) for own in segments]
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        for (text, source), at in zip(normalised, places, strict=True):
            begins, counts = self.pool_begins[at], self.pool_counts[at]
            ids = _gather(self.pool_ids, begins, counts)
            ends = np.cumsum(_gather(self.pool_covered, begins, counts), dtype=np.int64)
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            if source is None:
                source = self._by_marks(text)
            yield ids, source[starts], source[ends]

    def _by_marks(self, text: str) -> np.ndarray:
        """Source bytes of normalised bytes where every mark stands for one space, and the prefix for nothing."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        source = np.arange(len(data) + 1)
        if len(data) > 2:
            is_mark = np.zeros(len(data) + 1, dtype=np.int64)
            is_mark[3:] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            source = source - 2 * np.cumsum(is_mark) - self.dummy_prefix
            source[: 3 * self.dummy_prefix] = 0
        return source

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are spaces, the prefix's is dropped, bytes are read as UTF-8."""
        surfaces = self.surfaces
        data = b"".join([surfaces[i] for i in ids.tolist()])
        if self.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode(errors="replace")


def _gather(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of values that begin at begins, one after the other."""
    if not len(counts):
        return values[:0]
    ends = np.cumsum(counts)
    return values[np.arange(ends[-1]) + np.repeat(begins - ends + counts, counts)]


@lru_cache(maxsize=2)
def load(data: bytes) -> Model:
    """The model of a file's bytes, kept by a worker from task to task."""
    return Model(data)


def read_model(path: str) -> bytes:
    """A model file's bytes, read where the job is started; tasks get them with a broadcast."""
    with open(path, "rb") as file:
        return file.read()


RESULT = "ids array<int>, starts array<int>, ends array<int>, decoded string"


def encode_texts(df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, ids with the end id, byte spans of each id in the source (the end id's is empty) and the decoded text."""
    ship(df.sparkSession)
    id_type = df.select(F.col(f"`{id_col}`")).dtypes[0][1]
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                ids, starts, ends, decoded = [], [], [], []
                for got, first, last in model.encode_many(batch.column(1).to_pylist()):
                    size = np.array([last[-1] if len(last) else 0])
                    ids.append(np.append(got, np.int32(model.end)))
                    starts.append(np.concatenate((first, size)).astype(np.int32))
                    ends.append(np.concatenate((last, size)).astype(np.int32))
                    decoded.append(model.decode(ids[-1]))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(decoded, pa.string())], names=[id_col, "ids", "starts", "ends", "decoded"])

    texts = df.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    return texts.mapInArrow(tidy(run), f"`{id_col}` {id_type}, {RESULT}")
