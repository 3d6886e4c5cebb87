"""Word shingles of whole texts as sets of 64-bit hashes, made in numpy for a batch at a time.

Words are runs of bytes other than white space, with A-Z lower-cased. The hash of every word of a
batch comes from one running sum of keyed bytes times powers of an odd number; a shingle's hash
is a mixed sum of its words' hashes. A set of shingles is a sorted array of distinct hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are worked on at once; a longer text is a batch of its own.
SLICE_BYTES = 1 << 18
BITS = 512

_random = np.random.default_rng(20_111)
_BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_BASE = int(_random.integers(1, 2**61)) * 8 + 3
_PLACES = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SHORT = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    size = max(2 * SLICE_BYTES, n)
    if size not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            powers = np.full(size, base & (2**64 - 1), dtype=np.uint64)
            powers[0] = 1
            tables.append(np.cumprod(powers, dtype=np.uint64))
        tables = tuple(tables)
        if size > 2 * SLICE_BYTES:
            return tables  # for one very long text; not kept
        _powers[size] = tables
    return _powers[size]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text, data[offsets[k]:offsets[k + 1]], its set of shingles."""
    n_docs = len(offsets) - 1
    empty = np.zeros(0, dtype=np.uint64)
    if not len(data):
        return [empty] * n_docs
    word = ~_GAP[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=run[1:])
    hashes = mix((run[ends] - run[starts]) * down[starts])
    del run
    windows = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(SHINGLE):
        windows[: len(hashes) - k] += hashes[k:] * _PLACES[k]
    windows = mix(windows)
    word_starts = np.searchsorted(starts, offsets)
    out = []
    for begin, end in zip(word_starts[:-1].tolist(), word_starts[1:].tolist(), strict=True):
        if end - begin >= SHINGLE:
            out.append(np.unique(windows[begin : end - SHINGLE + 1]))
        elif end > begin:
            n = end - begin
            out.append(mix((hashes[begin:end] * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + _SHORT[n]))
        else:
            out.append(empty)
    return out


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text of a binary column, with bounded memory beside the longest text."""
    if not len(column):
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        end = min(end, len(column))
        yield from shingle_sets(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """Two numbers that tell sets apart."""
    a = int(mix(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)) if len(tokens) else 0
    b = int(mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) if len(tokens) else 0
    return a - 2**64 if a >= 2**63 else a, b - 2**64 if b >= 2**63 else b


def parity_bits(tokens: np.ndarray) -> bytes:
    """512 bits, each the parity of the tokens that fall on it: two sets differ in as many tokens as bits, at least."""
    counts = np.bincount(((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()
