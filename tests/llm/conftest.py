import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=0, n=60):
    """Rows of documents with nulls, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 120))) for _ in range(n // 4)]
    texts = []
    for k in range(n):
        words = base[k % len(base)].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", "  \t\n", "one two", "one two", "One TWO", "a b c d e", " ".join(vocabulary) * 40, "\u00e9\u00c9 \U0001f600 x y z q"]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[0], rows[0], rows[len(base)], (None, base[0], "en", "a", 3), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
