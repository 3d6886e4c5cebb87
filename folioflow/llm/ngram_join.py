"""N-gram Jaccard self-join of documents with adaptive multi-match prefixes.

Documents are sets of 5-word shingles. Two link when 100 * intersection >= threshold * union, and
the result names the connected component of every document.

Equal sets are one class. A class of n shingles shares at least t = ceil(n * threshold / 100) with any
partner, so with all tokens in one global order, the first n - t + l tokens of two partners have
at least l in common, for every l up to t. The order puts counted tokens first, by how many classes have
them, then the others by hash; counted are the tokens whose hash lies in the lowest ``COUNTED``
of its range, so that a class hands over little more than its prefix. Each class picks the l, up
to ``MAX_MATCHES``, at which its estimated cost is least: every class met in its prefix's lists is
scanned, and a candidate, which uses up l of these meetings, is verified. A pair is a candidate
when the tokens shared within both prefixes, at the smaller of the two l, number at least that l.

Counting goes by slices of classes: a slice hands over each of its tokens once, and gets back the
counts of those that others have too. Lists of one token longer than ``CHUNK`` are cut into chunks and
dealt out by pairs of chunks. Parity bits of the sets drop pairs that differ too much before they leave
the task, which loses none.

A group of very many near copies isn't expanded into its pairs: a first round links the members of long
lists with leaders, those with the fewest tokens of their own, a second round each member with the one outside of
its component that its parity bits are nearest to; both verify their pairs. The last round looks at all lists, and
leaves out only pairs that are connected already.

Lists go to buckets by classes of size, as partners' sizes are alike, and a class is cut into as many buckets
as its postings fill: a pair of partners meets in few of them, so its shared tokens are summed before the shuffle.

Edge cases: a null or empty text, or one without words, has no shingle, is linked with nothing
and its own component; a text of fewer than five words is one shingle of all of them; repeated ids and
rows keep their rows; a null id is a row with a component named by the least other id in it, or null; very
long texts are worked on whole; an empty table gives an empty result. Sets are told apart by 64-bit
hashes of shingles and of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import bloom
from folioflow.llm.common import cut, tidy
from folioflow.llm.components import components
from folioflow.llm.shingles import fingerprint, mix, parity_bits, sets_of
from folioflow.session import ship

THRESHOLD = 80
#: Share of the range of hashes whose tokens are counted.
COUNTED = 0.25
MAX_MATCHES = 8
#: Costs of meeting a class in a list and of verifying a candidate.
SCAN_COST, VERIFY_COST = 1.0, 20.0
CHUNK = 1024
#: Lists from this length on take part in the rounds of leaders and of nearest.
LONG_LIST = 4
SLICE_TOKENS = 400_000
#: Bytes of a token and its count on their way through a bucket.
COUNT_BYTES = 12
BUCKET_BYTES = 12 << 20
PAIRS_AT_ONCE = 100_000
#: Pairs in hand before their shared tokens are summed and handed over, and rows of pairs in a batch.
SUM_PAIRS, OUT_PAIRS = 1_000_000, 50_000
#: Rounds of candidates, in this order.
LEADERS, NEAREST, ALL = "leaders", "nearest", "all"
OUT_ROWS = 2000

ENTRY = np.dtype([("list", "<u8"), ("key", "<i8"), ("comp", "<i8"), ("n", "<u4"), ("rank", "<u2"), ("level", "u1"), ("matches", "u1"), ("side", "u1"), ("lower", "u1"), ("bits", "<u8", 8)])


def _least_overlap(n: np.ndarray, threshold: int) -> np.ndarray:
    return (n * threshold + 99) // 100


def shingled(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, counted: float = COUNTED) -> DataFrame:
    """id, text_hash, n and key of each text's set, its parity bits and its lowest hashes: those that are counted, and as many
    more as the longest prefix takes."""
    ship(df.sparkSession)
    limit = np.uint64(int(counted * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                key, check, size, bits, head = [], [], [], [], []
                for tokens in sets_of(batch.column(1)):
                    a, b = fingerprint(tokens)
                    n = len(tokens)
                    prefix = n - int(_least_overlap(np.int64(n), threshold)) + MAX_MATCHES
                    key.append(a)
                    check.append(b)
                    size.append(n)
                    bits.append(parity_bits(tokens))
                    head.append(tokens[: max(prefix, int(np.searchsorted(tokens, limit)))].tobytes())
                columns = [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (key, check, size)), pa.array(bits, pa.binary()), pa.array(head, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "key", "check", "n", "bits", "head"])

    id_type = df.select(f"`{id_col}`").dtypes[0][1]
    text = F.col(f"`{text_col}`")
    schema = f"id {id_type}, text_hash long, key long, check long, n long, bits binary, head binary"
    return df.select(F.col(f"`{id_col}`"), F.encode(F.coalesce(text, F.lit("")), "UTF-8"), F.xxhash64(text)).mapInArrow(tidy(run), schema)


# -- counting ----------------------------------------------------------------------------


def _slices(classes: DataFrame) -> DataFrame:
    """Classes packed into rows of about SLICE_TOKENS tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tokens = made = 0

        def row() -> pa.RecordBatch:
            number = (TaskContext.get().partitionId() << 32) + made
            heads = [h[4] for h in held]
            flat = lambda i, kind: np.array([h[i] for h in held], dtype=kind).tobytes()
            values = {
                "slice": pa.array([number], pa.int64()),
                "keys": pa.array([flat(0, "<i8")], pa.binary()),
                "ids": pa.array([flat(1, "<i8")], pa.binary()),
                "sizes": pa.array([flat(2, "<i8")], pa.binary()),
                "bits": pa.array([b"".join(h[3] for h in held)], pa.binary()),
                "lengths": pa.array([np.array([len(h) // 8 for h in heads], dtype="<i8").tobytes()], pa.binary()),
                "tokens": pa.array([b"".join(heads)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(values)

        for batch in batches:
            for one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(one)
                tokens += len(one[4]) // 8
                if tokens >= SLICE_TOKENS:
                    yield row()
                    held, tokens, made = [], 0, made + 1
        if held:
            yield row()

    return classes.select("key", "id_hash", "n", "bits", "head").mapInArrow(tidy(run), "slice long, keys binary, ids binary, sizes binary, bits binary, lengths binary, tokens binary")


def _counts(slices: DataFrame, buckets: int) -> DataFrame:
    """slice, tokens, dfs: for each slice the tokens that more than one class has, with their numbers of classes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, times = np.unique(np.frombuffer(raw, dtype=np.uint64), return_counts=True)
                bucket = (mix(tokens) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                tokens, times, bucket = tokens[order], times[order].astype("<u4"), bucket[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
                some = [(int(bucket[a]), tokens[a:b].tobytes(), times[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s[0] for s in some], pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array([s[1] for s in some], pa.binary()), pa.array([s[2] for s in some], pa.binary())],
                    names=["bucket", "slice", "tokens", "times"],
                )

    def count(table: pa.Table) -> pa.Table:
        raws, times = table.column("tokens").to_pylist(), table.column("times").to_pylist()
        tokens = np.frombuffer(b"".join(raws), dtype=np.uint64)
        once, place = np.unique(tokens, return_inverse=True)
        total = np.bincount(place, weights=np.frombuffer(b"".join(times), dtype="<u4"), minlength=len(once)).astype(np.int64)[place]
        slices_, out, at = [], [], 0
        for number, raw in zip(table.column("slice").to_pylist(), raws, strict=True):
            end = at + len(raw) // 8
            shared = np.flatnonzero(total[at:end] > 1) + at
            if len(shared):
                slices_.append(number)
                out.append((tokens[shared].tobytes(), total[shared].tobytes()))
            at = end
        return pa.table({"slice": pa.array(slices_, pa.int64()), "tokens": pa.array([x[0] for x in out], pa.binary()), "dfs": pa.array([x[1] for x in out], pa.binary())})

    dealt = slices.select("slice", "tokens").mapInArrow(spread, "bucket long, slice long, tokens binary, times binary")
    return dealt.groupBy("bucket").applyInArrow(count, "slice long, tokens binary, dfs binary")


# -- prefixes ----------------------------------------------------------------------------


def _prefixes(slices: DataFrame, counts: DataFrame, threshold: int, counted: float, max_matches: int) -> DataFrame:
    """key, id_hash, n, rank, matches, bits and the shared tokens of the prefix with their levels and counts.

    A token's level is the least l whose prefix has it. rank: a class's share of tokens of its own, for the choice of leaders.
    """
    limit = np.uint64(int(counted * 2**64))
    answers = counts.groupBy("slice").agg(F.collect_list(F.struct("tokens", "dfs")).alias("answers"))
    joined = slices.join(answers, "slice").select("keys", "ids", "sizes", "bits", "lengths", "tokens", F.col("answers.tokens").alias("shared"), F.col("answers.dfs").alias("dfs"))

    def one(keys: np.ndarray, ids: np.ndarray, n: np.ndarray, bits: bytes, lengths: np.ndarray, tokens: np.ndarray, shared: np.ndarray, dfs: np.ndarray) -> list[tuple]:
        order = np.argsort(shared)
        shared, dfs = shared[order], dfs[order]
        place = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        df = np.where(shared[place] == tokens, dfs[place], 1)
        owner = np.repeat(np.arange(len(n)), lengths)
        order = np.lexsort((tokens, np.where(tokens < limit, df, np.iinfo(np.int64).max), owner))
        tokens, df = tokens[order], df[order]
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(tokens)) - starts[owner]
        overlap = _least_overlap(n, threshold)
        level = np.maximum(1, place - (n - overlap)[owner] + 1)
        live = (df > 1) & (level <= max_matches)
        best, least = np.ones(len(n), dtype=np.int64), None
        for matches in range(1, max_matches + 1):
            met = np.bincount(owner, weights=(df - 1) * (live & (level <= matches)), minlength=len(n))
            cost = np.where(matches <= overlap, met * (SCAN_COST + VERIFY_COST / matches), np.inf)
            if least is None:
                least = cost
            better = cost < least
            best[better], least = matches, np.where(better, cost, least)
        kept = live & (level <= best[owner])
        enough = np.bincount(owner[kept], minlength=len(n)) >= best
        kept &= enough[owner]
        own = np.bincount(owner, weights=df == 1, minlength=len(n)) / np.maximum(lengths, 1)
        rank = (own * 65_535).astype(np.int64)
        where = np.flatnonzero(kept)
        ends = np.cumsum(np.bincount(owner[where], minlength=len(n)))
        rows = []
        for k in np.flatnonzero(enough):
            at = where[ends[k - 1] if k else 0 : ends[k]]
            rows.append((int(keys[k]), int(ids[k]), int(n[k]), int(rank[k]), int(best[k]), bits[64 * k : 64 * k + 64], tokens[at].tobytes(), level[at].astype(np.uint8).tobytes(), df[at].tobytes()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = ["key", "id_hash", "n", "rank", "matches", "bits", "tokens", "levels", "dfs"]
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind="<i8", i=i: np.frombuffer(batch.column(c)[i].as_py(), dtype=kind)
                joined_ = lambda c, kind, i=i: np.frombuffer(b"".join(batch.column(c)[i].as_py()), dtype=kind)
                rows = one(get(0), get(1), get(2), batch.column(3)[i].as_py(), get(4), get(5, np.uint64), joined_(6, np.uint64), joined_(7, np.int64))
                for at in range(0, len(rows), OUT_ROWS):
                    some = rows[at : at + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], kind) for c, kind in enumerate(kinds)], names=names)

    return joined.mapInArrow(tidy(run), "key long, id_hash long, n long, rank int, matches int, bits binary, tokens binary, levels binary, dfs binary")


# -- candidates --------------------------------------------------------------------------


def _size_class(n: np.ndarray) -> np.ndarray:
    """Sizes from a power of four up to the next are one class."""
    return (np.frexp(n.astype(np.float64))[1] - 1) // 2


def _buckets(alive: DataFrame) -> dict[int, int]:
    """How many buckets each class of sizes fills: one row for each power of four is all that comes to the driver."""
    size_class = F.floor(F.log(2.0, F.col("n") + 0.5) / 2).cast("int")
    rows = alive.groupBy(size_class.alias("c")).agg(F.sum(F.length("tokens") / 8).alias("postings")).collect()
    return {r["c"]: int(r["postings"] * ENTRY.itemsize // BUCKET_BYTES) + 1 for r in rows}


def _deal(alive: DataFrame, buckets: dict[int, int], kind: str, threshold: int) -> DataFrame:
    """bucket, entries: postings of the lists, packed.

    For all pairs a long list is dealt by pairs of its chunks, else chunk by chunk. A posting near the upper end of its
    class of sizes is dealt to the next class, too, where it meets only those of that class.
    """
    most = max(buckets, default=0) + 2
    parts = np.array([buckets.get(c, 1) for c in range(most + 1)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(first, OUT_ROWS)
                get = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
                raws = get(6)
                lengths = np.array([len(t) // 8 for t in raws], dtype=np.int64)
                owner = np.repeat(np.arange(len(raws)), lengths)
                df = np.frombuffer(b"".join(get(8)), dtype=np.int64)
                e = np.zeros(len(owner), dtype=ENTRY)
                e["list"] = np.frombuffer(b"".join(raws), dtype=np.uint64)
                e["level"] = np.frombuffer(b"".join(get(7)), dtype=np.uint8)
                for name, c in (("key", 0), ("n", 2), ("rank", 3), ("matches", 4), ("comp", 9)):
                    e[name] = np.array(get(c), dtype=np.int64)[owner]
                e["bits"] = np.frombuffer(b"".join(get(5)), dtype="<u8").reshape(-1, 8)[owner]
                chunks = -(-df // CHUNK)
                # By list and class, so that two classes in one long list often meet in a chunk of another.
                own = (mix(mix(e["list"]) ^ e["key"].astype(np.uint64)) % chunks.astype(np.uint64)).astype(np.int64)
                if kind == ALL:
                    again = np.repeat(np.arange(len(e)), chunks)
                    other = np.arange(len(again)) - (np.cumsum(chunks) - chunks)[again]
                    e, own = e[again], own[again]
                else:
                    e, own = e[df >= LONG_LIST], own[df >= LONG_LIST]
                    other = own
                low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
                e["side"] = np.where(low == high, 2, own > other)
                size_class = _size_class(e["n"])
                near = np.flatnonzero(e["n"].astype(np.int64) * 100 >= threshold * 4 ** (size_class + 1).astype(np.int64))
                raised = e[near]
                raised["lower"] = 1
                e, low, high = (np.concatenate((x, y)) for x, y in ((e, raised), (low, low[near]), (high, high[near])))
                size_class = np.concatenate((size_class, size_class[near] + 1)).astype(np.uint64)
                e["list"] = mix(e["list"] + low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xD1B54A32D192ED03) + size_class * np.uint64(0xA0761D6478BD642F))
                bucket = (size_class << np.uint64(40) | e["list"] % parts[size_class.astype(np.int64)]).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                e, bucket = e[order], bucket[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
                some = [(int(bucket[a]), e[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in some], pa.int64()), pa.array([s[1] for s in some], pa.binary())], names=["bucket", "entries"])

    return alive.select("key", "id_hash", "n", "rank", "matches", "bits", "tokens", "levels", "dfs", "comp").mapInArrow(tidy(run), "bucket long, entries binary")


def _fits(e: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of entries may link and count for their multi-match."""
    na, nb = e["n"][a].astype(np.int64), e["n"][b].astype(np.int64)
    fine = (e["comp"][a] != e["comp"][b]) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * threshold)
    fine &= np.maximum(e["level"][a], e["level"][b]) <= np.minimum(e["matches"][a], e["matches"][b])
    sides = e["side"][a], e["side"][b]
    fine &= ((sides[0] == 2) | (sides[0] != sides[1])) & ((e["lower"][a] & e["lower"][b]) == 0)
    at = np.flatnonzero(fine)
    # At least 2 t / (1 + t) of the sizes' sum is shared by partners, so at most the rest of it differs.
    differ = np.bitwise_count(e["bits"][a[at]] ^ e["bits"][b[at]]).sum(axis=1, dtype=np.int64)
    fine[at] = differ * (100 + threshold) <= (na[at] + nb[at]) * (100 - threshold)
    return fine


def _all_pairs(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs inside each list that may link; the lists of one size go together."""
    for d in np.unique(sizes[sizes > 1]).tolist():
        lists = starts[sizes == d]
        i, j = np.triu_indices(d, 1)
        step, part = max(1, PAIRS_AT_ONCE // len(i)), PAIRS_AT_ONCE
        for at in range(0, len(lists), step):
            for p in range(0, len(i), part):
                a = (lists[at : at + step, None] + i[None, p : p + part]).ravel()
                b = (lists[at : at + step, None] + j[None, p : p + part]).ravel()
                fine = _fits(e, a, b, threshold)
                yield a[fine], b[fine]


def _leader_pairs(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In each list, in the order of ranks, an entry without a leader leads all those left that may link with it."""
    for start, d in zip(starts.tolist(), sizes.tolist(), strict=True):
        order = start + np.lexsort((e["key"][start : start + d], e["rank"][start : start + d]))
        while len(order) > 1:
            led = _fits(e, np.full(len(order) - 1, order[0]), order[1:], threshold)
            yield np.full(int(led.sum()), order[0]), order[1:][led]
            order = order[1:][~led]


def _nearest_pairs(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each entry the one of its list, among those that may link with it, that its bits are nearest to."""
    order = np.lexsort((e["key"], e["rank"]))
    place = np.empty(len(e), dtype=np.uint64)
    place[order] = np.arange(len(e), dtype=np.uint64)
    none = np.uint64(2**64 - 1)
    best = np.full(len(e), none)
    for a, b in _all_pairs(e, starts, sizes, threshold):
        differ = np.bitwise_count(e["bits"][a] ^ e["bits"][b]).sum(axis=1, dtype=np.uint64)
        share = (differ * np.uint64(1 << 16) // (e["n"][a].astype(np.uint64) + e["n"][b])) << np.uint64(32)
        np.minimum.at(best, a, share | place[b])
        np.minimum.at(best, b, share | place[a])
    has = np.flatnonzero(best != none)
    yield has, order[(best[has] & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _candidates(alive: DataFrame, buckets: dict[int, int], threshold: int, kind: str) -> DataFrame:
    """Pairs (a, b), a below b, with as many shared tokens in their prefixes as their multi-match wants."""

    choose = {LEADERS: _leader_pairs, NEAREST: _nearest_pairs, ALL: _all_pairs}[kind]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([np.frombuffer(x.as_buffer(), dtype=ENTRY) for batch in batches for x in batch.column(at)])
        e = e[np.argsort(e["list"], kind="stable")]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(e["list"])) + 1)).astype(np.int64)
        sizes = np.diff(np.append(starts, len(e)))
        comps = e["comp"]
        mixed = (np.minimum.reduceat(comps, starts) != np.maximum.reduceat(comps, starts)) & (sizes > 1)
        keys, first, place = np.unique(e["key"], return_index=True, return_inverse=True)
        wanted = e["matches"][first].astype(np.int32)

        def summed(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """The pairs in hand, each once with its shared tokens; those handed over before are added to them after the shuffle."""
            once, times = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            for begin in range(0, len(once), OUT_PAIRS):
                low, high = once[begin : begin + OUT_PAIRS] // len(keys), once[begin : begin + OUT_PAIRS] % len(keys)
                yield pa.RecordBatch.from_pydict({"a": keys[low], "b": keys[high], "wanted": np.minimum(wanted[low], wanted[high]), "shared": times[begin : begin + OUT_PAIRS]})

        new, held = [], 0
        for a, b in choose(e, starts[mixed], sizes[mixed], threshold):
            if len(a):
                new.append(np.minimum(place[a], place[b]) * len(keys) + np.maximum(place[a], place[b]))
                held += len(a)
            if held > SUM_PAIRS:
                yield from summed(new)
                new, held = [], 0
        yield from summed(new)

    dealt = _deal(alive, buckets, kind, threshold)
    at = dealt.columns.index("entries")
    met = dealt.groupBy("bucket").applyInArrow(pair, "a long, b long, wanted int, shared long")
    return met.groupBy("a", "b", "wanted").agg(F.sum("shared").alias("shared")).filter("shared >= wanted").select("a", "b")


def _whole_sets(df: DataFrame, alive: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """key, set: the whole sets of the classes in alive, from one document of each.

    Documents that a Bloom filter of the classes' first ids lets pass are shingled again, in the same worker; an exact
    join drops what passed by chance.
    """
    texts = df.select(F.xxhash64(F.col(f"`{id_col}`")).alias("id_hash"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("raw"))
    shared = df.sparkSession.sparkContext.broadcast(bloom.build(alive.select("id_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            passed = whole.filter(pa.array(shared.value.may_have(whole.column(0).to_numpy(zero_copy_only=False)), pa.bool_())) if whole.num_rows else whole
            for at in range(0, passed.num_rows, OUT_ROWS):
                sets = list(sets_of(passed.column(1).slice(at, OUT_ROWS)))
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])

    found = texts.mapInArrow(tidy(run), "key long, set binary")
    return found.join(alive.select("key"), "key", "left_semi").groupBy("key").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    one = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    two = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    joined = pairs.join(one, "b").join(two, "a").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(tidy(run), "a long, b long")


@dataclass
class _Classes:
    """docs: id, text_hash, n, key of every row. alive: classes with a prefix that others share, and sets: their whole sets."""

    docs: DataFrame
    alive: DataFrame
    sets: DataFrame
    buckets: dict[int, int]


def _classes(df: DataFrame, text_col: str, id_col: str, threshold: int, counted: float, max_matches: int) -> _Classes:
    """Shingles every text once; whole sets are made again only for the classes that may link."""
    rows = cut(shingled(df, text_col, id_col, threshold, counted))
    tokens = rows.agg(F.sum(F.length("head") / 8)).first()[0] or 0
    count_buckets = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(tokens * COUNT_BYTES // BUCKET_BYTES) + 1)
    classes = rows.filter("n > 0").groupBy("key", "check", "n").agg(F.min("id").alias("first_id"), F.first("bits").alias("bits"), F.first("head").alias("head"))
    slices = cut(_slices(classes.withColumn("id_hash", F.xxhash64("first_id"))))
    alive = cut(_prefixes(slices, _counts(slices, count_buckets), threshold, counted, max_matches))
    return _Classes(rows.select("id", "text_hash", "n", "key"), alive, cut(_whole_sets(df, alive, text_col, id_col)), _buckets(alive))


def _linked(df: DataFrame, text_col: str, id_col: str, threshold: int, counted: float, max_matches: int) -> DataFrame:
    """For every row of df: id, text_hash, n, key, and comp, which is equal in one component (key where there is no link)."""
    found = _classes(df, text_col, id_col, threshold, counted, max_matches)
    links = None
    marked = found.alive.withColumn("comp", F.col("key"))
    for kind in (LEADERS, NEAREST, ALL):
        new = cut(_verified(_candidates(marked, found.buckets, threshold, kind), found.sets, threshold))
        links = new if links is None else links.union(new)
        linked = components(links).withColumnRenamed("node", "key")
        marked = found.alive.join(linked, "key", "left").withColumn("comp", F.coalesce("component", "key"))
    return found.docs.join(linked, "key", "left").select("id", "text_hash", "n", "key", F.coalesce("component", "key").alias("comp"))


def join(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, counted: float = COUNTED, max_matches: int = MAX_MATCHES) -> DataFrame:
    """id_col, n_shingles and component_id for every row of df."""
    docs = cut(_linked(df, text_col, id_col, threshold, counted, max_matches))
    with_words = docs.filter("n > 0")
    # A table of its own, so that the join's sides are plain shuffles and one component's many rows can be split.
    named = cut(with_words.groupBy("comp").agg(F.min("id").alias("component_id")))
    out = with_words.join(named, "comp").select("id", "n", "component_id").union(docs.filter("n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def links(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, counted: float = COUNTED, max_matches: int = MAX_MATCHES
) -> tuple[DataFrame, DataFrame]:
    """All links: membership (id_col, n_shingles, class_id, n_links), and pairs (class_a, class_b) of classes that link.

    A class is the rows with equal sets, named by its least id; n_links counts the other rows that a row links with, those
    of its own class included; a row without words is a class by itself (class_id its id) without links. Every pair of different sets is verified and none is left out, so
    a group of n near copies costs n * n / 2 verifications: where only components are asked for, join is cheaper.
    """
    found = _classes(df, text_col, id_col, threshold, counted, max_matches)
    apart = found.alive.withColumn("comp", F.col("key"))
    pairs = cut(_verified(_candidates(apart, found.buckets, threshold, ALL), found.sets, threshold))
    named = cut(found.docs.filter("n > 0").groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("rows")))
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(named.select(F.col("key").alias("b"), "rows"), "b").groupBy("a").agg(F.sum("rows").alias("near"))
    counted_ = cut(named.join(near.withColumnRenamed("a", "key"), "key", "left").select("key", "class_id", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    with_words = found.docs.filter("n > 0").join(counted_, "key").select("id", "n", "class_id", "n_links")
    without = found.docs.filter("n = 0").select("id", "n", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    membership = with_words.union(without).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "n_links")
    name = lambda side: named.select(F.col("key").alias(side), F.col("class_id").alias(f"class_{side}"))
    return membership, pairs.join(name("a"), "a").join(name("b"), "b").select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))


def keep_first(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of df without those whose component has a document with a smaller id; with df's own columns.

    Of rows with the same id in one component the one with the least hash of its text stays, of equal rows one.
    Rows without words are linked with nothing and stay. A Bloom filter of the rows in question sends few others
    through the exact joins; all the rest goes straight on.
    """
    docs = cut(_linked(df, text_col, id_col, threshold, COUNTED, MAX_MATCHES).filter("n > 0").groupBy("comp", "id", "text_hash").agg(F.count("*").alias("rows")))
    stays = cut(docs.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("s")))
    judged = docs.join(stays, "comp").select("id", "text_hash", "rows", F.expr("NOT (id <=> s.id AND text_hash = s.text_hash)").alias("lost"))
    suspects = cut(judged.filter("lost OR rows > 1"))
    names = df.columns
    row = df.select(F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))).alias("__h"), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)))
    marked = bloom.flagged(row, "__h", bloom.build(suspects.select(F.xxhash64("id", "text_hash"))), "__maybe")
    keys = suspects.select(F.xxhash64("id", "text_hash").alias("__h"), F.col("id").alias("s_id"), F.col("text_hash").alias("s_hash"), "lost")
    i, t = names.index(id_col), names.index(text_col)
    met = marked.filter("__maybe").join(keys, "__h", "left").filter(F.expr(f"s_hash IS NULL OR (__{i} <=> s_id AND xxhash64(__{t}) = s_hash)"))
    # Of equal rows one stays; a row that only the filter took for one in question is told apart by a number of its own.
    apart = met.filter("lost IS NULL OR NOT lost").withColumn("__apart", F.when(F.col("lost").isNull(), F.monotonically_increasing_id()))
    once = apart.dropDuplicates([f"__{i}", "s_hash", "__apart"]).select(*row.columns)
    out = marked.filter("NOT __maybe").select(*row.columns).union(once)
    return out.select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(names)))
