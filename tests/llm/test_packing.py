import random
import zlib
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import packing
from folioflow.llm.packing import best_fit, contents, crossover, evolve, filled, fitness, least_sequences, mutate
from folioflow.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string"
JSON = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(JSON))


def by_hand(counts, capacity):
    """Best fit, longest first, one document at a time; the sequences' rooms."""
    rooms = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_of_counts_is_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 7) for _ in range(rng.randint(1, 40))}
    packed = best_fit({}, counts, 100)
    assert contents(packed) == counts
    assert sorted(100 - filled(p) for p, n in packed.items() for _ in range(n)) == by_hand(counts, 100)


@pytest.mark.parametrize("seed", range(10))
def test_children_hold_every_document_once_and_fit(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(40)}
    a, b = best_fit({}, counts, 100), best_fit({}, counts, 100, rng)
    for _ in range(10):
        a = mutate(crossover(a, b, 100, rng), 100, rng)
        assert contents(a) == counts and max(map(filled, a)) <= 100 and min(a.values()) > 0


def test_evolution_never_loses_its_best_and_finds_better_packings():
    better = 0
    for seed in range(6):
        rng = random.Random(seed)
        counts = {rng.randint(300, 520): rng.randint(1, 9) for _ in range(200)}
        first = best_fit({}, counts, 1024)
        out = evolve([first, *(best_fit({}, counts, 1024, rng) for _ in range(5))], 1024, rng, 20)
        assert fitness(out[0]) <= fitness(first) and contents(out[0]) == counts
        assert fitness(out[0])[0] >= least_sequences(counts)
        better += fitness(out[0])[0] < fitness(first)[0]
    assert better >= 3


def test_islands_agree_in_reruns_and_their_elite_wanders(spark):
    rng = random.Random(4)
    counts = {rng.randint(300, 520): rng.randint(1, 9) for _ in range(100)}
    found = [packing.search(spark, counts, islands=3, epochs=2, population=3, children=2) for _ in range(2)]
    assert found[0] == found[1] and contents(found[0]) == counts
    alone = best_fit({}, counts, 1024)
    assert fitness(found[0]) <= fitness(alone)
    assert packing.search(spark, {}) == {}


def test_counts_beyond_memory_cost_nothing():
    counts = {1: 10**12, 700: 10**10, 512: 3, 1024: 10**9}
    packed = best_fit({}, counts, 1024)
    assert contents(packed) == counts and len(packed) < 10


def test_encoder_equals_the_library(tokenizer):
    with open(tokenizer_path(JSON), encoding="utf-8") as file:
        encoder = packing.byte_encoder(file.read())
    rng = random.Random(2)
    pieces = ["a", "Word", "'s", "'LL", " ", "  ", "\n", "\t\r\n", "\x0b\x85\xa0　", "12", "½", "é", "字", "\U0001f600", ".,", "<|endoftext|>", "<|endof", "\x00", "́"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, encoded in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packing.token_bytes(encoder, text), "<u4").tolist() == [*encoded.ids, 2]


def test_spans_of_long_texts_end_where_tokens_do(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 7)
    with open(tokenizer_path(JSON), encoding="utf-8") as file:
        encoder = packing.byte_encoder(file.read())
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice([" ", "\n", "ab", "cd'll", "1", " <|endoftext|>", "…", "　"]) for _ in range(60))
        assert np.frombuffer(packing.token_bytes(encoder, text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def checked(tokenizer, texts, rows, capacity=1024):
    """Rows against the contract: every document's pieces, their hashes, and sequences without gaps."""
    expected = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) - capacity * (-(-len(ids) // capacity) - 1)
        start = 0
        for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
            part = ids[start:stop]
            expected[(doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
            start = stop
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    inside = {}
    for r in rows:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside), Counter(r["length"] for r in rows)


def test_packed_documents_follow_the_contract(spark, docs, tokenizer):
    df = docs.withColumnsRenamed({"lang": "length", "source": "rank", "n_chars": "__part"})
    out = packing.pack(df.repartition(3), tokenizer_path(JSON), islands=2, epochs=1)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and len(out.columns) == 7
    n, counts = checked(tokenizer, [(r["doc_id"], r["text"]) for r in docs.collect()], out.collect())
    assert least_sequences(counts) <= n <= len(by_hand(counts, 1024))


def test_long_texts_ties_and_small_capacity(spark, tokenizer):
    rng = random.Random(5)
    texts = [(k % 20, " ".join(rng.choice(["alpha", "beta", "x", "zz"]) for _ in range(rng.choice([0, 1, 5, 31, 32, 300])))) for k in range(120)] + [(None, None), (1, ""), (1, "")]
    out = packing.pack(spark.createDataFrame(texts, SCHEMA), tokenizer_path(JSON), capacity=32, islands=2, epochs=1, with_ids=True)
    n, counts = checked(tokenizer, texts, out.collect(), 32)
    assert n <= len(by_hand(counts, 32))
    whole = packing.sequences(out).collect()
    assert len(whole) == n and all(len(r["tokens"]) == 4 * r["n_tokens"] for r in whole)
    ends = sum((np.frombuffer(r["tokens"], "<u4") == 2).sum() for r in whole)
    assert ends >= len(texts)


def test_no_documents(spark, no_docs):
    out = packing.pack(no_docs, tokenizer_path(JSON))
    assert out.collect() == [] and "sequence_id" in out.columns
