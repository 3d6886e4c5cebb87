import random
import zlib
from collections import Counter

import pytest

from folioflow.llm import spelling

LETTERS = [chr(c) for c in (*range(97, 123), *range(192, 256))]


def near(a, b):
    """Whether two words differ by exactly one letter put in, taken out or exchanged."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def by_hand(texts, lose_one_in=None, min_length=5, min_count=3, factor=2):
    counts = Counter()
    for doc_id, text in texts:
        runs = "".join(c if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or c in LETTERS else " " for c in text or "").split(" ")
        for run in runs:
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            if not word:
                continue
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if lose_one_in and h % lose_one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    out, form = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
        out[w] = (n, len(others))
    rows = []
    for w, (n, n_near) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, n_near, words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def grouped(df, **options):
    return sorted(map(tuple, spelling.group_variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def family(seed, size, alphabet="abcdé"):
    """Texts of words near each other, with repeats in steps of two, and words of one multiset of letters."""
    rng = random.Random(seed)
    words = []
    for _ in range(size):
        base = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 7)))
        for _ in range(6):
            at = rng.randrange(len(base))
            base = rng.choice([base[:at] + base[at + 1 :], base[:at] + rng.choice(alphabet) + base[at:], base[:at] + rng.choice(alphabet) + base[at + 1 :], "".join(sorted(base)), base[::-1]])
            words += [base] * rng.choice([1, 3, 3, 6, 12, 24])
    rng.shuffle(words)
    return [(k, ", ".join(words[k::20])) for k in range(20)]


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_the_plain_computation(spark, seed):
    texts = family(seed, 60)
    found = grouped(spark.createDataFrame(texts, "doc_id long, text string"))
    assert found == by_hand(texts) and sum(r[1] is not None for r in found) > 20 and max(r[4] for r in found) > 3


def test_lost_letters_cases_nulls_and_repeated_rows(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(LETTERS[:40]) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = [(rng.choice([None, *range(30)]), " ".join(rng.choice([w, w.upper(), w.title(), f"{w}1{w}", f"×{w}÷"]) for w in rng.choices(vocabulary, k=60))) for _ in range(60)]
    texts += [texts[0], texts[0], (None, None), (3, ""), (4, " \n.")]
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, n long, word string")
    assert grouped(df, lose_one_in=7) == by_hand(texts, 7)


def test_equal_counts_take_the_smaller_form_and_chains_reach_the_root(spark):
    words = ["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 96 + ["zzzzz"] * 3 + ["zzzzx"] * 6 + ["zzzxz"] * 6
    texts = [(1, " ".join(words))]
    found = {r[0]: r for r in grouped(spark.createDataFrame(texts, "doc_id long, text string"))}
    assert found["aaaaa"][1:3] == ("aaaab", "bbbbb") and found["zzzzz"][1] == "zzzxz" and found["bbbbb"][1:3] == (None, "bbbbb")
    assert sorted(found.values(), key=str) == by_hand(texts)


def test_one_anagram_family_makes_few_candidates(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.sample("abcdefghij", 10)) for _ in range(2000)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    assert spelling.near_pairs(df).count() == 0
    valued = df.select("word", "n", spelling.anagram_value(df["word"]).alias("value"))
    assert valued.select("value").distinct().count() == 1
    offers = spelling._offers(valued, spelling.F.length("word"))
    largest = offers.groupBy("value", "half").count().agg({"count": "max"}).first()[0]
    assert largest <= 24, "only words with the same half meet"


def test_differences_of_powers_tell_the_exchange():
    powers = [ord(c) ** 5 for c in LETTERS]
    assert len({a - b for a in powers for b in powers if a != b}) == len(powers) * (len(powers) - 1)


def test_long_words_and_spans(spark, monkeypatch):
    long = "abcdefghij" * 400
    texts = [(1, " ".join([long, long, long, long[:-1], long[:-1], long[:-1], long + "x"])), (2, "shorter words here " * 3)]
    assert grouped(spark.createDataFrame(texts, "doc_id long, text string")) == by_hand(texts)
    monkeypatch.setattr(spelling, "SPAN", 3)
    text = "ab cdé,fghij kl  m" * 5
    assert [w for some in spelling.runs(text) for w in some] == spelling.RUN.findall(text)


def test_no_documents(spark, no_docs):
    out = spelling.group_variants(no_docs)
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
