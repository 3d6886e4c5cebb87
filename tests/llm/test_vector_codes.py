import hashlib
import math
import random

import numpy as np
import pytest

from folioflow.llm import vector_codes
from folioflow.llm.vector_codes import KdTree

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, parts, entries, rounds):
    """The contract in plain Python: (vec_id, code, error, label_error) sorted, and the books' digest."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    firsts = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        firsts.setdefault(i, v)
    books = [[cut(v, p) for v in list(firsts.values())[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            for k, found in members.items():
                new[p][k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
        books = new
    coded = [(i, [nearest(p, cut(v, p)) for p in range(parts)], label) for i, v, label in kept]
    errors = {}
    for _, found, label in coded:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in found)
    rows = [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), errors[label]) for i, found, label in coded]
    return rows, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def coded(spark, rows, schema=SCHEMA, **sizes):
    out = vector_codes.compress(spark.createDataFrame(rows, schema), **sizes).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=key), {r["codebooks_sha256"] for r in out}


def vectors(seed, n, width):
    rng = random.Random(seed)
    rows = [(rng.randrange(10 * n), [round(rng.gauss(0, 0.02), 3) for _ in range(width)], rng.choice([None, 1, 1, 1, 2])) for _ in range(n)]
    return rows + [rows[0], rows[0], (rows[1][0], rows[2][1], 1), (None, rows[3][1], None), (-1, None, 1), (-2, [math.nan] + [0.0] * (width - 1), 1), (-3, [math.inf] + [0.0] * (width - 1), 1), (-4, [None] + [0.0] * (width - 1), 2)]


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_lowest_of_the_nearest(seed):
    rng = np.random.default_rng(seed)
    for entries, width, spread in ((1, 3, 3), (5, 2, 2), (64, 4, 3), (64, 1, 10), (200, 2, 1000)):
        book = rng.integers(-spread, spread + 1, (entries, width))
        points = rng.integers(-spread - 2, spread + 3, (width, 500))
        index, distance = KdTree(book).nearest(points)
        every = ((points.T[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


def test_tree_prunes():
    book = np.random.default_rng(1).integers(-1000, 1000, (64, 4))
    tree = KdTree(book)
    seen = []
    for node in tree.nodes:
        if node.members is not None:
            whole = node.members

            class Counted(list):
                def __iter__(self):
                    seen.append(1)
                    return super().__iter__()

            node.members = Counted(whole.tolist())
    tree.nearest(book[:1].T + 1)
    leaves = sum(n.members is not None for n in tree.nodes)
    assert len(seen) < leaves, "a point near an entry needn't visit all leaves"


@pytest.mark.parametrize("seed", range(2))
def test_codes_equal_the_plain_computation(spark, seed):
    rows = vectors(seed, 150, 8)
    expected, digest = by_hand(rows, 4, 16, 2)
    found, digests = coded(spark, rows, parts=4, entries=16, rounds=2)
    assert found == sorted(expected, key=key) and digests == {digest}


def test_fewer_vectors_than_entries_ties_and_negative_floors(spark):
    rows = [(3, [-0.001, 0.0], None), (1, [0.001, 0.0], None), (2, [0.0, -0.5], 4), (9, [0.0, 0.0], 4)]
    expected, digest = by_hand(rows, 2, 64, 2)
    found, digests = coded(spark, rows, parts=2)
    assert found == sorted(expected, key=key) and digests == {digest}


def test_no_rows_and_no_finite_rows(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan] * 16, 2)]):
        df = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == [] and df.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_other_columns_and_names_do_not_matter(spark):
    rows = vectors(7, 60, 4)
    df = spark.createDataFrame([(i, v, "one", "x", 5) for i, v, _ in rows], "`a.id` long, vec array<double>, group string, code string, error int")
    out = vector_codes.compress(df, "a.id", "vec", "group", parts=2, entries=8)
    expected, _ = by_hand([(i, v, "one") for i, v, _ in rows], 2, 8, 2)
    assert sorted(((r["a.id"], r["code"], r["error"]) for r in out.collect()), key=key) == sorted((e[:3] for e in expected), key=key)


def test_many_labels_take_the_salted_join(spark, monkeypatch):
    rows = vectors(5, 100, 4)
    expected, _ = by_hand(rows, 2, 8, 2)
    monkeypatch.setattr(vector_codes, "BROADCAST_BYTES", 0)
    found, _ = coded(spark, rows, parts=2, entries=8)
    assert found == sorted(expected, key=key)


def test_lengths_and_sizes_that_cannot_be_coded_are_errors(spark):
    for rows in ([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [0.0] * 15, 1)], [(1, [1e9] * 16, 1)]):
        with pytest.raises(Exception, match="components|length|beyond"):
            vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
