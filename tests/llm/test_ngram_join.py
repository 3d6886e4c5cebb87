from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA, WORD, make_docs
from pyspark.sql import functions as F

from folioflow.llm import bloom, ngram_join
from folioflow.llm.components import components
from folioflow.llm.queries import ORACLE_SQL, QUERIES
from folioflow.llm.shingles import shingle_sets, sets_of

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(id, size, component id) of each row, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("seed", [0, 1])
def test_join_equals_brute_force(spark, seed):
    rows = make_docs(seed, 120)
    got = [tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_links_equal_brute_force(spark):
    """Membership and pairs of all different texts, whatever is connected already."""
    rows = make_docs(3, 100)
    membership, pairs = ngram_join.links(spark.createDataFrame(rows, SCHEMA))
    sets = [shingles(r[1]) for r in rows]
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    least = {}
    for r, s in zip(rows, sets):
        if r[0] is not None:
            least[frozenset(s)] = min(least.get(frozenset(s), r[0]), r[0])
    want = Counter()
    for k, (r, s) in enumerate(zip(rows, sets)):
        want[(r[0], len(s), least[frozenset(s)] if s else r[0], sum(like(s, o) for j, o in enumerate(sets) if j != k))] += 1
    assert Counter(map(tuple, membership.collect())) == want
    once = sorted({s: least[s] for s in map(frozenset, sets) if s}.items(), key=lambda x: x[1])
    assert sorted(map(tuple, pairs.collect())) == sorted((m, n) for i, (a, m) in enumerate(once) for b, n in once[i + 1 :] if like(a, b))


def test_handed_over_in_parts(spark, monkeypatch):
    """Pairs whose shared tokens are summed in several goes."""
    monkeypatch.setattr(ngram_join, "SUM_PAIRS", 50)
    monkeypatch.setattr(ngram_join, "OUT_PAIRS", 7)
    rows = make_docs(5, 80)
    got = [tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_groups_over_chunks(spark, monkeypatch):
    """One group of near copies that is cut into several chunks."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in range(k % 5):
            words[(k * 37 + j * 53) % 200] = f"x{k}-{j}"
        rows.append((k, " ".join(words), "en", "a", 1))
    got = [tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_empty_table(no_docs):
    assert ngram_join.join(no_docs).count() == 0
    assert ngram_join.keep_first(no_docs).columns == no_docs.columns


def test_keep_first(spark, docs):
    clashing = docs.withColumns({"key": F.lit(1), "comp": F.lit("x"), "id": F.col("doc_id"), "n": F.lit(2), "__h": F.lit(0)})
    kept = ngram_join.keep_first(clashing)
    assert kept.columns == clashing.columns
    rows = make_docs()
    want = Counter()
    for row, (ident, size, component) in zip(rows, brute(rows)):
        if not size or ident == component:
            want[row[:2]] += 1
    for key in want:
        if shingles(key[1]):
            want[key] = 1
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op2_ngram_join", "op7_source_mix"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want = connection.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(map(shown, r)) for r in rows) == Counter(tuple(map(shown, r)) for r in want.fetchall())


def test_shingle_sets():
    texts = ["A b c d e f", "a B C d e", "", None, " \t ", "x y", "y x", "a" * 5000, "p q r s t p q r s t"]
    got = list(sets_of(pa.array([None if t is None else t.encode() for t in texts], pa.binary())))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    assert got[1][0] in got[0] and got[5][0] != got[6][0]
    joined = np.frombuffer(b"a b c d e", dtype=np.uint8)
    assert len(shingle_sets(joined, np.array([0, 4, 9]))) == 2


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (2, 1), *[(100 + i, 101 + i) for i in range(30)]], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **dict.fromkeys(range(100, 131), 100)}
    assert components(links.limit(0)).count() == 0


def test_bloom(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    filter_ = bloom.build(keys)
    assert bloom.possible(keys, "h", filter_).count() == 5000
    others = spark.range(10**6, 10**6 + 20000).select(F.xxhash64("id").alias("h"))
    assert bloom.possible(others, "h", filter_).count() < 2000
    small = bloom.build(keys, max_bytes=64)
    assert small.bits.nbytes == 64 and bloom.possible(keys, "h", small).count() == 5000
    assert bloom.possible(keys, "h", bloom.build(keys.limit(0))).count() == 0
