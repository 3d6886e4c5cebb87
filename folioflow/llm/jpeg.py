"""Media columns: baseline JPEG.

Decoding parses the markers, Huffman-decodes the scan and rebuilds a DC-only luminance thumbnail,
one sample for each 8 x 8 block. Scans are decoded in step with each other: every restart interval
of every image in a batch is a lane, and each step decodes one code in all lanes with numpy.

A payload of bytes is stored as an image of flat blocks. Its DC coefficient at a quantiser of 8 is
the byte less 128, so that the thumbnail is the payload itself: 192 blocks to a row, one restart
interval to a row, at most 8191 rows to an image, and as many images one after the other as it takes.

Edge cases: a null payload or text is empty; bytes that aren't baseline JPEG give null dimensions
and an empty thumbnail instead of an error; very long payloads take several images; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import ship

ROW = 192
MAX_ROWS = 8191
BATCH_BYTES = 2 << 20
#: Rows that are encoded at once.
BLOCK_ROWS = 4096
#: Lengths and values of the standard luminance DC code (fixed values of the public format).
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: The AC code has the end of a block alone, as a single 0.
AC_BITS = (1, *(0,) * 15)
AC_VALUES = (0,)


def _codes(bits: tuple[int, ...], values: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Canonical codes: (value, code, length)."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


# -- encoding ----------------------------------------------------------------------------


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference plus 255: its code with its bits and the block's end, and the length."""
    by_size = {v: (c, n) for v, c, n in _codes(DC_BITS, DC_VALUES)}
    codes, lengths = [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = by_size[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        codes.append(((code << size) | extra) << 1)
        lengths.append(n + size + 1)
    return np.array(codes, dtype=np.int64), np.array(lengths, dtype=np.int64)


CODES, LENGTHS = _diff_codes()


def _header(rows: int) -> bytes:
    part = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    return b"".join(
        (
            b"\xff\xd8",
            part(0xDB, bytes([0, *[8] * 64])),
            part(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            part(0xC4, bytes([0x00, *DC_BITS, *DC_VALUES])),
            part(0xC4, bytes([0x10, *AC_BITS, *AC_VALUES])),
            part(0xDD, ROW.to_bytes(2, "big")),
            part(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        )
    )


def _encode_rows(rows: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Rows of 192 bytes as entropy-coded intervals one after the other, and where each begins and the last one ends."""
    samples = rows.astype(np.int16) - 128
    diffs = np.diff(samples, axis=1, prepend=np.int16(0))
    codes, lengths = CODES[diffs + 255], LENGTHS[diffs + 255]
    bits = lengths.sum(axis=1)
    row_bytes = (bits + 7) >> 3
    row_starts = np.cumsum(row_bytes) - row_bytes
    # Rows end with ones up to a whole byte.
    fill = row_bytes * 8 - bits
    codes = np.concatenate((codes, ((1 << fill) - 1)[:, None]), axis=1).ravel()
    lengths = np.concatenate((lengths, fill[:, None]), axis=1).ravel()
    at = np.cumsum(lengths) - lengths
    shifted = codes << (24 - lengths - (at & 7))
    size = int(row_bytes.sum())
    out = np.zeros(size + 3, dtype=np.float64)
    for k in range(3):
        out += np.bincount((at >> 3) + k, weights=(shifted >> (16 - 8 * k)) & 255, minlength=size + 3)[: size + 3]
    data = out[:size].astype(np.uint8)
    # A zero after each 255.
    full = np.flatnonzero(data == 255)
    data = np.insert(data, full + 1, 0)
    starts = np.append(row_starts, size)
    return data.tobytes(), starts + np.searchsorted(full, starts)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Stores payloads, whose lengths are multiples of 192, as JPEG images; a block of rows at a time, whatever their length."""
    counts = [len(p) // ROW for p in payloads]
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, ROW)
    blocks = [_encode_rows(samples[at : at + BLOCK_ROWS]) for at in range(0, len(samples), BLOCK_ROWS)]
    row_of = lambda k: blocks[k // BLOCK_ROWS][0][blocks[k // BLOCK_ROWS][1][k % BLOCK_ROWS] : blocks[k // BLOCK_ROWS][1][k % BLOCK_ROWS + 1]]
    result, row = [], 0
    for n in counts:
        images: list[bytes] = []
        for first in range(row, row + n, MAX_ROWS):
            last = min(first + MAX_ROWS, row + n)
            images += (_header(last - first), row_of(first))
            for k in range(first + 1, last):  # a restart mark after each row but an image's last
                images += (bytes((0xFF, 0xD0 | (k - first - 1) & 7)), row_of(k))
            images.append(b"\xff\xd9")
        result.append(b"".join(images))
        row += n
    return result


# -- decoding ----------------------------------------------------------------------------


@dataclass
class Image:
    """What the markers say: shape, and of the scan that has the first component: its size, components (h, v, quantiser of DC,
    DC code, AC code) with the first one's place among them, restart interval and lanes."""

    width: int
    height: int
    scan_width: int
    scan_height: int
    components: tuple[tuple[int, int, int, tuple, tuple], ...]
    luma: int
    interval: int
    lanes: list[tuple[int, int]] = field(default_factory=list)


def parse(data: bytes) -> tuple[list[Image], bool]:
    """The images of a stream of baseline JPEGs, each with the scan of its first component, and whether all of it could be read."""
    images: list[Image] = []
    at = 0
    dc_step: dict[int, int] = {}
    codes: dict[int, tuple] = {}
    frame, interval = None, 0
    try:
        while at < len(data):
            if data[at] != 0xFF:
                return images, False
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            if mark == 0xD8:
                frame, interval = None, 0
            if mark in (0xD8, 0xD9, 0x01):
                at += 2
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    dc_step[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                    k += 1 + 64 * (1 + wide)
            elif mark == 0xC4:
                k = 0
                while k < len(body):
                    bits = tuple(body[k + 1 : k + 17])
                    codes[body[k]] = (bits, tuple(body[k + 17 : k + 17 + sum(bits)]))
                    k += 17 + sum(bits)
            elif mark == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif mark == 0xC0:
                height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame = (width, height, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])})
            elif mark == 0xDA:
                if frame is None or not frame[0] or not frame[1] or not frame[2]:
                    return images, False
                width, height, parts = frame
                own = [body[1 + 2 * i] for i in range(body[0])]
                tables = [body[2 + 2 * i] for i in range(body[0])]
                used = [(*parts[c][:2], dc_step[parts[c][2]], codes[t >> 4], codes[0x10 | t & 15]) for c, t in zip(own, tables, strict=True)]
                size = width, height
                if len(used) == 1:  # a scan of one component goes block by block over that component's samples
                    h, v = max(x[0] for x in parts.values()), max(x[1] for x in parts.values())
                    size = -(-width * used[0][0] // h), -(-height * used[0][1] // v)
                    used = [(1, 1, *used[0][2:])]
                first = next(iter(parts))
                image = Image(width, height, *size, tuple(used), own.index(first) if first in own else -1, interval)
                # Restart marks cut the scan; any other mark ends it.
                begin = at
                while True:
                    at = data.find(b"\xff", at)
                    if at < 0 or at + 1 >= len(data):
                        return images, False
                    if data[at + 1] == 0:
                        at += 2
                    elif 0xD0 <= data[at + 1] <= 0xD7:
                        image.lanes.append((begin, at))
                        at = begin = at + 2
                    else:
                        image.lanes.append((begin, at))
                        break
                # A frame's other components may come in scans of their own, which the thumbnail has no need of.
                if image.luma >= 0:
                    images.append(image)
            elif 0xC1 <= mark <= 0xCF and mark != 0xCC:
                return images, False  # not baseline
    except (IndexError, KeyError):
        return images, False
    return images, bool(images)


def _lookup(code: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Length and value of the code that 16 bits begin with; length 0 where there is none."""
    length, value = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for v, c, n in _codes(*code):
        length[c << (16 - n) : (c + 1) << (16 - n)] = n
        value[c << (16 - n) : (c + 1) << (16 - n)] = v
    return length, value


def _window(bytes_: np.ndarray) -> np.ndarray:
    """From each byte on, 48 bits."""
    b = bytes_.astype(np.int64)
    out = np.zeros(len(b), dtype=np.int64)
    for k in range(6):
        out[: len(b) - k] |= b[k:] << (40 - 8 * k)
    return out


def decode_thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """For each stream its images' widths, heights and DC-only luminance, as arrays of bytes; None if it can't be read."""
    result: list[list[tuple[int, int, np.ndarray]] | None] = []
    groups: dict[tuple, list[tuple[Image, bytes, int, int]]] = defaultdict(list)
    for k, data in enumerate(streams):
        images, ok = parse(data)
        result.append([None] * len(images) if ok else None)
        if ok:
            for i, image in enumerate(images):
                groups[image.components, image.luma].append((image, data, k, i))
    for (components, luma), members in groups.items():
        for (image, _, k, i), thumb in zip(members, _decode_group(components, luma, [(m[0], m[1]) for m in members]), strict=True):
            if result[k] is not None:
                if thumb is None:
                    result[k] = None
                else:
                    result[k][i] = image.width, image.height, thumb
    return result


def _decode_group(components: tuple, luma_at: int, members: list[tuple[Image, bytes]]) -> list[np.ndarray | None]:
    """Images of one structure and one set of codes, all restart intervals in step."""
    h_max, v_max = max(c[0] for c in components), max(c[1] for c in components)
    tables = [(_lookup(c[3]), _lookup(c[4])) for c in components]
    chunks, starts, quota, owner, first_mcu = [], [], [], [], []
    place = 0
    shapes = []
    for n, (image, data) in enumerate(members):
        across, down = -(-image.scan_width // (8 * h_max)), -(-image.scan_height // (8 * v_max))
        shapes.append((across, down))
        total = across * down
        each = image.interval or total
        for k, (a, b) in enumerate(image.lanes):
            chunk = data[a:b].replace(b"\xff\x00", b"\xff")
            chunks.append(chunk)
            starts.append(place)
            place += len(chunk)
            quota.append(max(0, min(each, total - k * each)))
            owner.append(n)
            first_mcu.append(k * each)
    window = _window(np.frombuffer(b"".join(chunks) + b"\0" * 8, dtype=np.uint8))
    limit = len(window) - 8
    at = np.array(starts, dtype=np.int64) * 8
    stop = (np.array(starts) + np.array([len(c) for c in chunks])) * 8
    quota = np.array(quota)
    owner, first_mcu = np.array(owner), np.array(first_mcu)
    # Lanes with the most to do first, so that those still running are a leading slice.
    order = np.argsort(-quota, kind="stable")
    at, stop, quota, owner, first_mcu = at[order], stop[order], quota[order], owner[order], first_mcu[order]
    h, v = components[luma_at][:2]
    bases = np.cumsum([0, *(a * d * h * v for a, d in shapes)])
    across_of = np.array([a for a, _ in shapes])[owner] * h
    begin = bases[:-1][owner]
    luma = np.zeros(int(bases[-1]), dtype=np.uint8)
    broken = np.zeros(len(at), dtype=bool)
    before = [np.zeros(len(at), dtype=np.int64) for _ in components]
    step = components[luma_at][2]

    def take(spots: np.ndarray) -> np.ndarray:
        return (window[np.minimum(spots >> 3, limit)] << (spots & 7)) & 0xFFFFFFFFFFFF

    active = len(at)
    for mcu in range(int(quota[0]) if len(quota) else 0):
        while active and quota[active - 1] <= mcu:
            active -= 1
        for c, (ch, cv, _, _, _) in enumerate(components):
            (dc_length, dc_value), (ac_length, ac_value) = tables[c]
            for by in range(cv):
                for bx in range(ch):
                    bits = take(at[:active])
                    head = bits >> 32
                    n, size = dc_length[head], dc_value[head]
                    broken[:active] |= n == 0
                    extra = (bits >> (48 - n - size)) & ((1 << size) - 1)
                    before[c][:active] += np.where((extra >> np.maximum(size - 1, 0)) & 1 | (size == 0), extra, extra - (1 << size) + 1)
                    at[:active] += n + size
                    if c == luma_at:
                        spot = first_mcu[:active] + mcu
                        wide = across_of[:active] // h
                        place_ = (spot // wide * v + by) * across_of[:active] + spot % wide * h + bx
                        luma[begin[:active] + place_] = np.clip((before[c][:active] * step + 4) // 8 + 128, 0, 255)
                    # AC codes are passed over: all lanes at once, then those whose block goes on.
                    rest = np.arange(active)
                    k = np.ones(active, dtype=np.int64)
                    while len(rest):
                        head = take(at[rest]) >> 32
                        n, value = ac_length[head], ac_value[head]
                        broken[rest[n == 0]] = True
                        at[rest] += n + (value & 15)
                        k += np.where(value == 0xF0, 16, (value >> 4) + 1)
                        goes_on = (value != 0) & (n > 0) & (k < 64)
                        rest, k = rest[goes_on], k[goes_on]
    broken |= at > stop
    bad = set(owner[broken].tolist())
    out: list[np.ndarray | None] = []
    for n, (image, _) in enumerate(members):
        if n in bad:
            out.append(None)
            continue
        grid = luma[bases[n] : bases[n + 1]].reshape(shapes[n][1] * v, shapes[n][0] * h)
        # Blocks past the picture's edge are padding.
        out.append(grid[: -(-image.scan_height * v // (8 * v_max)), : -(-image.scan_width * h // (8 * h_max))])
    return out


def hashes(grid: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash of a thumbnail: 64 bits each, from means over cells."""
    sums = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), dtype=np.int64)
    sums[1:, 1:] = grid.astype(np.int64).cumsum(axis=0).cumsum(axis=1)

    def cells(rows: int, columns: int) -> np.ndarray:
        edge = lambda n, size: (np.arange(n) * size // n, np.maximum(np.arange(1, n + 1) * size // n, np.arange(n) * size // n + 1))
        (r0, r1), (c0, c1) = edge(rows, grid.shape[0]), edge(columns, grid.shape[1])
        total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
        return total * 1000 // np.outer(r1 - r0, c1 - c0)

    number = lambda flags: int.from_bytes(np.packbits(flags.ravel()).tobytes(), "big")
    small, wide = cells(8, 8), cells(8, 9)
    return number(small * 64 > small.sum()), number(wide[:, 1:] > wide[:, :-1])


# -- Spark -------------------------------------------------------------------------------


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose bytes in the column stay near BATCH_BYTES."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()] if batch.num_rows else []
    first = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > BATCH_BYTES:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if sizes:
        yield batch.slice(first)


def store_payloads(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_bytes and media: the text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, as JPEG."""
    ship(df.sparkSession)
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                raw = batch.column(1).to_pylist()
                media = encode_payloads([x + b" " * (-len(x) % ROW if x else ROW) for x in raw])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    raw = df.select(id_col, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    return raw.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, media binary")


def describe(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds width, height, n_images, thumbnail (the DC-only luminance, images one after the other), average_hash, difference_hash.

    Width and height are the frame's; those of several images of one width, which are one picture cut across, are taken
    together. Columns of df with these names are replaced.
    """
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in ("width", "height", "n_images", "thumbnail", "average_hash", "difference_hash")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    at = kept.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, at):
                width, height, images, thumbs, average, difference = [], [], [], [], [], []
                media = [x or b"" for x in batch.column(at).to_pylist()]
                for found in decode_thumbnails(media):
                    images.append(len(found) if found else 0)
                    thumbs.append(b"".join(x.tobytes() for _, _, x in found) if found else b"")
                    if not found:
                        for x in (width, height, average, difference):
                            x.append(None)
                        continue
                    one = found[:1] if len({(w, x.shape[1]) for w, _, x in found}) > 1 else found
                    a, d = hashes(np.concatenate([x for _, _, x in one]))
                    width.append(one[0][0])
                    height.append(sum(h for _, h, _ in one))
                    average.append(f"{a:016x}")
                    difference.append(f"{d:016x}")
                new = [pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(images, pa.int32()), pa.array(thumbs, pa.binary()), pa.array(average, pa.string()), pa.array(difference, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, "width", "height", "n_images", "thumbnail", "average_hash", "difference_hash"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, f"{schema}, width int, height int, n_images int, thumbnail binary, average_hash string, difference_hash string")
