"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed entry is a host and a path prefix; it fits its host and all subdomains. A page's URL has candidate keys: each
suffix of its host with each prefix of its path that ends with a slash. An entry's own key is
its host and its path cut after the last slash, so every entry that fits a URL has a key among
the URL's candidates. Keys are hashes that grow with the labels of a host from the right and with the path from the
left, so that a URL's candidates cost as much as it is long; suffixes of hosts that nothing is listed for go before
they meet any path. The Bloom filter, a fixed number of bytes that is checked against a bound, drops nearly all
candidates inside the tasks; what is left meets the list in a shuffled hash join on the key, and the join's rows are
then compared exactly, so a false positive changes nothing. Keys that very many URLs have are spread by a salt.

Entries of kind ``rule`` are compared with URLs as they are. All others are compared in canonical form: user name, port
and dots at the end of the host dropped, escapes of unreserved characters resolved, ``.`` and ``..`` worked out, an
empty path a slash.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no entry;
repeated page ids and repeated rows are judged one by one; an empty list fits nothing, an empty table gives an empty
result; very long URLs are judged whole, at a cost in proportion to their length; of
entries equally long the one with the longer host wins, then the first by host, path and verdict; of the pages' columns
only the id and the URL are read, whatever the others are called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.bloom import MAX_FILTER_BYTES, BlockedBloom, build
from folioflow.llm.common import cut
from folioflow.session import ship

#: URLs of one key that a single task takes; a key with more is dealt out by a salt.
HOT_ROWS = 1 << 20
#: Candidates that are tested at once.
TESTED = 1 << 17
#: Marks a key of a host alone, in the place of a path's hash.
ALONE = 0xFFFFFFFF
ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def parse(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path: the host lower-cased in A-Z, both empty without ``://``."""
    url = F.col(f"`{url_col}`")
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return df.withColumn("__rest", rest).withColumns(
        {"host": F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER), "path": F.regexp_extract("__rest", r"(?s)^[^/?#]*([^?#]*)", 1)}
    ).drop("__rest")


# -- canonical form ----------------------------------------------------------------------


def _unescaped(text: str) -> str:
    def one(match: re.Match) -> str:
        c = chr(int(match[1], 16))
        return c if c in UNRESERVED else match[0].upper()

    return ESCAPE.sub(one, text)


def canonical(host: str, path: str) -> tuple[str, str]:
    """One form for all ways to write a host and a path; an empty host stays empty."""
    host = _unescaped(host.rpartition("@")[2]).translate(TO_LOWER)
    host = (host if host.startswith("[") else host.partition(":")[0]).rstrip(".")
    kept: list[str] = []
    parts = _unescaped(path).split("/")[1:]
    for part in parts:
        if part == "..":
            del kept[-1:]
        elif part != ".":
            kept.append(part)
    if parts and parts[-1] in (".", ".."):
        kept.append("")
    return host, "/" + "/".join(kept)


# -- keys --------------------------------------------------------------------------------


def _list_keys(listed: DataFrame) -> DataFrame:
    """listed with key, that of its host and its path up to and with the last slash, and alone, that of its host."""
    backwards = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    of_host = F.shiftleft(F.crc32(F.encode(backwards, "UTF-8")), 32)
    of_path = F.crc32(F.encode(F.regexp_extract("path", r"(?s)^.*/|^", 0), "UTF-8"))
    return listed.withColumns({"key": of_host.bitwiseOR(of_path), "alone": of_host.bitwiseOR(F.lit(ALONE))})


def host_hashes(host: str) -> list[int]:
    """The hash of each suffix of a host that starts at a label, from the last label on."""
    out, so_far = [], 0
    for label in reversed(host.encode().split(b".")):
        so_far = zlib.crc32(label + b".", so_far)
        out.append(so_far)
    return out


def path_hashes(path: str) -> list[int]:
    """The hash of each prefix of a path that is empty or ends with a slash."""
    data = memoryview(path.encode())
    out, so_far, at = [0], 0, 0
    raw = bytes(data)
    while (end := raw.find(b"/", at)) >= 0:
        so_far = zlib.crc32(data[at : end + 1], so_far)
        out.append(so_far)
        at = end + 1
    return out


def candidates(urls: list[tuple[str, str]], filter_: BlockedBloom) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in urls (host, path) and keys of the candidates that the filter lets pass."""
    hosts = [host_hashes(h) if h else [] for h, _ in urls]
    owner = np.repeat(np.arange(len(urls)), [len(h) for h in hosts])
    high = np.array([x for h in hosts for x in h], dtype=np.uint64) << np.uint64(32)
    known = np.flatnonzero(filter_.may_have((high | np.uint64(ALONE)).view(np.int64))) if len(high) else []
    held_owner, held, n = [], [], 0
    paths: tuple[int, np.ndarray] = (-1, high)
    for k in known:
        if paths[0] != owner[k]:
            paths = int(owner[k]), np.array(path_hashes(urls[owner[k]][1]), dtype=np.uint64)
        held.append(paths[1] | high[k])
        held_owner.append(np.full(len(held[-1]), owner[k]))
        n += len(held[-1])
        if n >= TESTED or k == known[-1]:
            keys, whose = np.concatenate(held).view(np.int64), np.concatenate(held_owner)
            hit = filter_.may_have(keys)
            yield whose[hit], keys[hit]
            held_owner, held, n = [], [], 0


def directories(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """path: every directory that the canonical URLs of pages have, once. URLs without a host have none; the root is ``/``."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = {canonical("", p)[1] for p in set(batch.column(0).to_pylist())}
            yield pa.RecordBatch.from_pydict({"path": pa.array(sorted({p[: p.rindex("/") + 1] for p in whole}), pa.string())})

    hosted = parse(pages.select(F.col(f"`{url_col}`").alias("url"))).filter("host <> ''")
    return hosted.select("path").mapInArrow(run, "path string").distinct()


# -- matching ----------------------------------------------------------------------------


def _canonical_list(listed: DataFrame) -> DataFrame:
    """Listed entries as they are compared: rules as they are, all others in canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            both = [(h, p) if kind == "rule" else canonical(h, p) for h, p, kind in zip(rows["host"], rows["path"], rows["kind"], strict=True)]
            new = {"host": [b[0] for b in both], "path": [b[1] for b in both], "kind": rows["kind"], "verdict": rows["verdict"]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in new.items()})

    return listed.select("host", "path", "kind", "verdict").dropna(subset=["host", "path"]).mapInArrow(run, "host string, path string, kind string, verdict string")


def _salted(hits: DataFrame, entries: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both with salt: 0, or for a key of more than hot_rows hits one of as many numbers as it takes; entries have all of them.

    There are fewer hot keys than hits divided by hot_rows, so their table is small beside both.
    """
    hot = cut(hits.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("key", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")))
    if hot.isEmpty():
        return hits.withColumn("salt", F.lit(0)), entries.withColumn("salt", F.lit(0))
    number = F.coalesce("salts", F.lit(1))
    dealt = hits.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.hash("host", "path"), number)).drop("salts")
    return dealt, entries.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), number - 1))).drop("salts")


def match(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_FILTER_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The best entry for each page: id_col, host, path, and the entry's host, path, kind and verdict or nulls.

    listed: columns host, path, kind, verdict. An entry of kind ``rule`` goes before any other kind.
    """
    spark = ship(pages.sparkSession)
    parsed = parse(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))).select("id", "host", "path")
    keyed = cut(_list_keys(_canonical_list(listed)))
    shared = spark.sparkContext.broadcast(build(keyed.select(F.explode(F.array("key", "alone")).alias("h")).distinct(), max_bytes))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Whole URLs are judged once each, however often they repeat in the batch.
            urls = list(dict.fromkeys(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            canon = [canonical(*u) for u in urls]
            other = [k for k, (u, c) in enumerate(zip(urls, canon, strict=True)) if u != c]
            back = np.concatenate((np.arange(len(urls)), np.array(other, dtype=np.int64)))
            for place, keys in candidates(urls + [canon[k] for k in other], shared.value):
                whose = back[place].tolist()
                columns = [[urls[k][0] for k in whose], [urls[k][1] for k in whose], [canon[k][0] for k in whose], [canon[k][1] for k in whose]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(keys, pa.int64())], names=["host", "path", "host_c", "path_c", "key"])

    hosted = parsed.filter("host <> ''")
    hits = cut(hosted.select("host", "path").mapInArrow(possible, "host string, path string, host_c string, path_c string, key long"))
    dealt, entries = _salted(hits, keyed.select("key", F.struct("host", "path", "kind", "verdict").alias("e")), hot_rows)
    own = F.col("e.kind") == "rule"
    seen = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"{c}_c"))
    in_host = (seen("host") == F.col("e.host")) | F.endswith(seen("host"), F.concat(F.lit("."), F.col("e.host")))
    order = F.struct(
        own.alias("rule"), (F.length("e.host") + F.length("e.path")).alias("whole"), F.length("e.host").alias("long_host"), F.col("e.host"), F.col("e.path"), F.col("e.verdict")
    )
    met = dealt.join(entries.hint("shuffle_hash"), ["key", "salt"]).filter(in_host & F.startswith(seen("path"), F.col("e.path")))
    # A table of its own, so that a URL that very many pages have can be split in the join.
    fits = cut(met.groupBy("host", "path").agg(F.max_by("e", order).alias("e")))
    judged = hosted.join(fits, ["host", "path"], "left").select("id", "host", "path", "e")
    without = parsed.filter("host = ''").withColumn("e", F.lit(None).cast(fits.schema["e"].dataType))
    return judged.unionByName(without).select(
        F.col("id").alias(id_col), "host", "path", F.col("e.host").alias("entry_host"), F.col("e.path").alias("entry_path"), F.col("e.kind").alias("kind"), F.col("e.verdict").alias("verdict")
    )
