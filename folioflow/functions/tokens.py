"""Signed tokens, as Spark's own expressions, and repaired JSON, which Spark has no expression for, in Arrow batches."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _packed(data: Column) -> Column:
    """Base64 in letters that links can have, without what fills it up."""
    return F.translate(F.regexp_replace(F.base64(data), r"[\r\n=]", ""), "+/", "-_")


def _mark(payload: Column, key: bytes) -> Column:
    """A payload's HMAC with SHA-256: two hashes, each of the padded key and what it covers."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    digest = lambda pad, data: F.unhex(F.sha2(F.concat(pad, data), 256))
    return _packed(digest(outer, digest(inner, F.encode(payload, "UTF-8"))))


def mint(ident: Column, purpose: str, issued: Column, key: bytes) -> Column:
    """A token for an id and a purpose, issued at a time in seconds; null for a null id or time."""
    payload = F.concat(ident.cast("string"), F.lit(f":{purpose}:"), issued.cast("string"))
    return F.concat(_packed(F.encode(payload, "UTF-8")), F.lit("."), _mark(payload, key))


def verify(token: Column, purpose: str, now: int | Column, key: bytes, lifetime: int = 30 * 86_400) -> Column:
    """The id of a token that is signed, for this purpose and not too old; null for any other."""
    body, mark = (F.split_part(token, F.lit("."), F.lit(k)) for k in (1, 2))
    filled = F.rpad(F.translate(body, "-_", "+/"), (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    payload = F.try_to_binary(filled, F.lit("base64")).cast("string")
    ident, kind, at = (F.split_part(payload, F.lit(":"), F.lit(k)) for k in (1, 2, 3))
    age = (now if isinstance(now, Column) else F.lit(now)) - at.try_cast("long")
    whole = (F.size(F.split(token, r"\.", -1)) == 2) & (F.size(F.split(payload, ":", -1)) == 3)
    return F.when(whole & (mark == _mark(payload, key)) & (kind == purpose) & age.between(0, lifetime), ident.try_cast("long"))


def _whole_objects(text: str) -> str:
    """The array of the objects at the first level that are complete in a cut-off text."""
    found, decoder, at = [], json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            break
        found.append(value)
        at = text.find("{", end)
    return json.dumps(found)


def repaired_array(text: Column) -> Column:
    """JSON text of an array, from text that may be fenced or cut off in the middle of an object."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_whole_objects(t or "") for t in texts])

    return run(text)
