"""Bounds on what is fitted on, and queries against plain computations of their contracts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SCHEMA, make_docs
from pyspark.sql import functions as F

from folioflow.llm import chat_format, language_id, queries, toxicity, url_filters
from folioflow.llm.language_id import EMBED, FILTERS, WIDTHS, WINDOW, ByteCnn

ROWS = make_docs(3, 24)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    """One labelled id is in the documents very often; what reaches the driver is bounded all the same."""
    texts = [(k, f"plain words of text number {k}. awful vile things." if k % 3 == 0 else f"plain words of text number {k}.") for k in range(60)]
    texts += [(1, f"plain words, version {k}.") for k in range(300)]
    labels = [(k, int(k % 3 == 0)) for k in range(60)]
    seen = []
    whole = toxicity._fit_weights
    monkeypatch.setattr(toxicity, "_fit_weights", lambda bags, chosen: (seen.append(len(bags)), whole(bags, chosen))[1])
    documents, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(documents, marks, max_docs=200)
    assert seen == [200] and model.weights
    toxicity.fit(documents, marks, max_docs=1000)
    assert seen[1] == 360


def test_all_windows_of_a_text_may_be_trained_on(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda windows, labels, languages: seen.append((windows, labels)))
    long = "".join(f"{k:04d}" + "x" * (WINDOW - 4) for k in range(50))
    rows = [(1, long, "a"), (2, "short one", "b"), (3, "two windows " * 20, "b"), (4, "no label", None), (5, "12 34", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language_id.fit(df, max_windows=1000)
    windows, labels = seen[0]
    heads = {bytes(w[:4]) for w, y in zip(windows, labels, strict=True) if y == 0}
    assert heads == {b"%04d" % k for k in range(50)} and len(windows) == 50 + 1 + 2
    language_id.fit(df, max_windows=12)
    windows, labels = seen[1]
    assert len(windows) == 12 and (labels == 1).sum() == 3, "short texts' windows come before a long one's later ones"
    language_id.fit(df.union(df), max_windows=12)
    assert len(seen[2][0]) == 12


def by_loops(model, text):
    """The network, filter by filter and place by place."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    total, weight = np.zeros(len(model.languages)), 0
    for at in range(0, max(1, len(data)), WINDOW):
        window = data[at : at + WINDOW]
        x = window.ljust(WINDOW)
        pooled = []
        for i, w in enumerate(WIDTHS):
            for f in range(FILTERS):
                best = -math.inf
                for place in range(WINDOW - w + 1):
                    r = model.bias[i * FILTERS + f]
                    for j in range(w):
                        r += float(np.dot(model.embed[x[place + j]], model.filters[i][j][:, f]))
                    best = max(best, r)
                pooled.append(max(0.0, best))
        z = [sum(p * model.out[k][c] for k, p in enumerate(pooled)) + model.out_bias[c] for c in range(len(model.languages))]
        e = [math.exp(v - max(z)) for v in z]
        total += np.array(e) / sum(e) * len(window)
        weight += len(window)
    return total / weight


def test_the_network_equals_loops(spark):
    rng = np.random.default_rng(1)
    model = ByteCnn(["a", "b", "c"], rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, 0.5, (w, EMBED, FILTERS)) for w in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS), rng.normal(0, 0.5, (len(WIDTHS) * FILTERS, 3)), rng.normal(0, 0.3, 3))
    texts = ["Some Words", "x", "Ein längerer Text, " * 12, "é" * 79 + "zz", "a" * WINDOW, "b" * (WINDOW + 1)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    for k, text in enumerate(texts):
        p = by_loops(model, text)
        assert got[k]["lang_pred"] == model.languages[int(p.argmax())] and got[k]["score"] == pytest.approx(p.max(), abs=1e-4)


def test_token_digests_equal_the_library(spark, folder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = sorted((str(doc_id), *(lambda ids: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))(library.encode(text or "") + [library.eos_id()])) for doc_id, text, *_ in ROWS)
    rows = queries.op9_sentencepiece(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_media_digests_equal_the_payload(spark, folder):
    rows = queries.op4_jpeg_media(spark, folder).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        data = (text or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        want.append((str(doc_id), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == sorted(want)
    by_payload = {}
    for r in rows:
        by_payload.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())


def test_parts_of_conversations_equal_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(8)
    turns = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice(["ann", "bob", "system", None]), rng.choice([None, "", "é" * rng.randint(1, 90), "word " * rng.randint(1, 200)])) for _ in range(150)]
    turns += turns[:10]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    size = 3000
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["length"], m["train"].cast("int")))
    got = chat_format.rotate_whole(df, whole_bytes=size).withColumn("mask", F.array_join(spans, " "))
    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    sql = queries.OP3_SQL.replace(str(chat_format.WHOLE_BYTES), str(size))
    names = ["conv_id", "part", "perspective", "n_turns", "n_trained", "text", "mask"]
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in got.collect()) and max(w[1] for w in want) > 1


def test_url_query_on_the_derived_list(spark, tmp_path):
    """The registered query in plain Python: what is listed comes from the pages' own directories."""
    hosts = ["m.spam-farm.example.com", "casino-win.example.org", "xcasino-win.example.org", "www.example.com", "Ads-Track.Example.NET.", "me:pw@www.adult-x.example.com:80", "free%2Dbets.example.org", "a.net", "example.org", "", "blog.cheap-pills.example.net"]
    paths = ["", "/", "/en/1.html", "/es/2?u=/fr/", "/a/../b/c", "/a/..", "/%61/x#/", "/fr/deep/er/", "/\nen/"]
    urls = [None, "", "no scheme", *(f"http://{h}{p}" for h in hosts for p in paths)]
    rows = [(k, u, None, k) for k, u in enumerate(urls + urls[:20])]
    spark.createDataFrame(rows, "page_id long, url string, html string, path int").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")

    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]

    known = [url_filters.canonical(*split(u)) for u in urls if split(u)[0]]
    listed = {(site, path[: path.rindex("/") + 1]) for _, path in known for site in queries.SPAM_SITES}
    got_list = [tuple(r) for r in queries.spam_list(spark.read.parquet(f"{tmp_path}/pages.parquet")).select("host", "path").collect()]
    assert len(got_list) == len(listed) and set(got_list) == listed and {p for _, p in listed} > {"/", "/en/", "/b/", "/a/", "/fr/deep/er/"}

    def under(host, site):
        return host == site or host.endswith("." + site)

    want = []
    for k, url, *_ in rows:
        host, path = split(url)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in queries.RULES if under(host, h) and path.startswith(p)]
        clean = url_filters.canonical(host, path)
        spam = host and any(under(clean[0], h) and clean[1].startswith(p) for h, p in listed)
        rule, verdict = max(fits)[1:] if fits else (None, "block" if spam else "allow")
        want.append((k, host, path, rule, verdict))
    got = queries.op10_url_filters(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got] == want
    assert {w[3:] for w in want} >= {(None, "block"), (None, "allow"), ("com/", "allow"), ("net/es/", "block")}
