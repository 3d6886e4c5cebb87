"""A blocked Bloom filter of 64-bit hashes, filled by Spark and bounded in size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.shingles import mix
from folioflow.session import ship

BLOCK_BITS = 512
MAX_FILTER_BYTES = 64 << 20
#: Blocks of one range are merged in one place.
RANGE_BLOCKS = 4096


class BlockedBloom:
    """Bits in blocks of one cache line each: a key's probes all fall into one block."""

    def __init__(self, n_keys: int, bits_per_key: int = 12, probes: int = 6, max_bytes: int = MAX_FILTER_BYTES) -> None:
        self.probes = probes
        # Beyond the bound the filter stays at the bound: more false positives, which the exact join behind it removes.
        self.blocks = min(max(1, -(-n_keys * bits_per_key // BLOCK_BITS)), max(1, max_bytes * 8 // BLOCK_BITS))
        self.bits = np.zeros((self.blocks, BLOCK_BITS // 8), dtype=np.uint8)

    def spots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash and its bits inside that block."""
        h = mix(hashes.view(np.uint64))
        block = (h >> np.uint64(32)) % np.uint64(self.blocks)
        step = np.arange(1, self.probes + 1, dtype=np.uint64)[None, :]
        low = h[:, None] & np.uint64(0xFFFFFFFF)
        return block.astype(np.int64), ((low * (step * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))) >> np.uint64(55)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        set_bits(self.bits, *self.spots(hashes))

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        block, bit = self.spots(hashes)
        return ((self.bits[block[:, None], bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all(axis=1)


def set_bits(bits: np.ndarray, block: np.ndarray, bit: np.ndarray) -> None:
    np.bitwise_or.at(bits, (block[:, None], bit >> 3), np.uint8(1) << (bit & 7).astype(np.uint8))


def build(hashes: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> BlockedBloom:
    """The filter over a DataFrame of one long column.

    Each task makes the ranges of the filter that its keys touch, ranges are merged by OR in Spark,
    and the filter, of at most max_bytes, comes to the driver.
    """
    ship(hashes.sparkSession)
    n = hashes.count()
    filter_, lean = (BlockedBloom(n, max_bytes=max_bytes) for _ in range(2))
    blocks, width = filter_.blocks, RANGE_BLOCKS * BLOCK_BITS // 8
    lean.bits = lean.bits[:0]  # goes to the tasks without its bits

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ranges that this task's keys touch: no more bytes than a range for each key, however large the filter is."""
        ranges: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = lean.spots(batch.column(0).to_numpy(zero_copy_only=False))
            for part in np.unique(block // RANGE_BLOCKS).tolist():
                mine = np.flatnonzero(block // RANGE_BLOCKS == part)
                bits = ranges.setdefault(part, np.zeros((min(RANGE_BLOCKS, blocks - part * RANGE_BLOCKS), BLOCK_BITS // 8), dtype=np.uint8))
                set_bits(bits, block[mine] - part * RANGE_BLOCKS, bit[mine])
        for part, bits in ranges.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range at a time, however many tasks have touched it."""
        part, total = None, None
        for batch in batches:
            for number, raw in zip(batch.column("part").to_pylist(), batch.column("bits"), strict=True):
                bits = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                part, total = number, bits.copy() if total is None else np.bitwise_or(total, bits, out=total)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    merged = hashes.mapInArrow(fill, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary")
    flat = filter_.bits.reshape(-1)
    for row in merged.collect():
        flat[row["part"] * width : row["part"] * width + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return filter_


def flagged(df: DataFrame, hash_col: str, filter_: BlockedBloom, flag: str) -> DataFrame:
    """Adds flag: whether the row's hash may be in the filter. Columns pass through the tasks as they are."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(filter_)
    at = df.columns.index(hash_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = shared.value.may_have(batch.column(at).to_numpy(zero_copy_only=False)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.bool_())], names=[*batch.schema.names, flag])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in df.columns), f"`{flag}` boolean"]))


def possible(df: DataFrame, hash_col: str, filter_: BlockedBloom) -> DataFrame:
    """The rows of df whose hash may be in the filter."""
    return flagged(df, hash_col, filter_, "__maybe").filter("__maybe").drop("__maybe")
