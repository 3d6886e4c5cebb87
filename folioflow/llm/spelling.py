"""Grouping of spelling variants by anagram hashing.

A word's anagram value is the sum of its letters' fifth powers (modulo a prime, so that no word is too long). Words that are near,
that is, differ by one letter added, removed or exchanged, have values that differ by one letter's power or by the difference of two. So each
word offers its value with each of its letters taken out: where that meets another word's own value one letter was removed,
where it meets another word's value with a letter taken out a letter was exchanged. Values forget the order of
letters; candidates are therefore verified on the words themselves.

Two near words also agree in their first or in their second half, so a half's hash is part of the join key and letters are taken out of the
other half only. Words that share a value, anagrams and large families of a stem alike, thus meet only where half of the word is
the same, whatever the size of the family.

A word's form is its commonest near word, if that is at least twice as common; following forms leads to a root. A form is at least twice as
common as its word, so chains are short, and roots are found by doubling: in each round every word takes over the root of its root.

Edge cases: null and empty texts have no words; a very long text is read in spans between words; a null id reads as an empty one where words lose a letter;
repeated rows count again; of forms of one count the smallest in code-point order is taken; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import cut, tidy
from folioflow.session import ship

MIN_LENGTH = 5
MIN_COUNT = 3
#: A form is at least so many times as common as its word.
FACTOR = 2
#: Anagram values are taken modulo this prime.
PRIME = (1 << 61) - 1
#: Letters of a run of letters, and what ends one.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
OTHER = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {upper: upper + 32 for upper in range(65, 91)}
#: Characters of a text that are read at once, and distinct words that a task holds before it hands their counts over.
SPAN = 1 << 20
HELD = 200_000


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, in spans that end where no run is."""
    start = 0
    while start < len(text):
        end = OTHER.search(text, start + SPAN) if start + SPAN < len(text) else None
        stop = end.start() if end else len(text)
        yield RUN.findall(text, start, stop)
        start = stop


def document_words(id_: str, text: str, lose_one_in: int | None) -> Counter:
    """A text's lower-cased words. With lose_one_in, words whose hash with the id it divides lose the letter that the hash tells."""
    found: Counter = Counter()
    for some in runs(text):
        found.update(some)
    out: Counter = Counter()
    for run, n in found.items():
        out[run if run.islower() and run.isascii() else run.translate(LOWER)] += n
    if lose_one_in is None:
        return out
    kept: Counter = Counter()
    for word, n in out.items():
        h = zlib.crc32(f"{id_}:{word}".encode())
        if h % lose_one_in == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        kept[word] += n
    return kept


def count_words(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lose_one_in: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of all words of enough letters and occurrences. Tasks add up their own counts before the shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_over() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in document_words(id_.as_py(), text.as_py(), lose_one_in).items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield hand_over()
        yield hand_over()

    texts = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text <> ''")
    return texts.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def power(letter: Column) -> Column:
    """A letter's share of an anagram value; letters reach code point 255, whose fifth power is far below the prime."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_value(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, letter: (total + power(letter)) % PRIME)


def _without(half: Column) -> Column:
    """The word's value with each distinct letter of a half taken out."""
    return F.transform(F.array_distinct(F.filter(F.split(half, ""), lambda x: x != "")), lambda letter: F.pmod(F.col("value") - power(letter), F.lit(PRIME)))


def _ends(size: Column) -> tuple[Column, Column]:
    """The first and the last letters of words that a near word of a given length shares: half of that length each."""
    first = (size / 2).cast("int")
    return F.substring("word", F.lit(1), first), F.substring("word", F.length("word") - (size - first) + 1, size - first)


def _offers(words: DataFrame, size: Column) -> DataFrame:
    """Rows (value, half, side, word, n): values with a letter of the rest taken out, for near words of a given length."""
    first, last = _ends(size)
    after = F.substring("word", F.length(first) + 1, F.length("word"))

    def out(side: int, half: Column, rest: Column) -> Column:
        return F.transform(_without(rest), lambda v: F.struct(v.alias("value"), F.xxhash64(F.lit(side), size, half).alias("half"), F.lit(side).alias("side")))

    offers = F.concat(out(0, first, after), out(1, last, first))
    return words.select("word", "n", F.explode(offers).alias("o")).select("o.value", "o.half", "o.side", "word", "n")


def _own(words: DataFrame) -> DataFrame:
    """Rows (value, half, word, n): the word's own value beside each of its halves."""
    first, last = _ends(F.length("word"))
    halves = F.array(*(F.xxhash64(F.lit(side), F.length("word"), half) for side, half in enumerate((first, last))))
    return words.select("value", F.explode(halves).alias("half"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of near words, each once. words: word and n, each word once, of two or more letters.

    A pair that agrees in both halves' terms is taken on the side of its first half alone.
    """
    valued = words.select("word", "n", anagram_value(F.col("word")).alias("value"))
    length = F.length("word")
    exchanged, removed = _offers(valued, length), _offers(valued, length - 1)
    side = lambda df, name: df.select("value", "half", *(("side",) if name == "a" else ()), F.col("word").alias(name), F.col("n").alias(f"{name}_n"))
    joined = side(exchanged, "a").join(side(exchanged, "b"), ["value", "half"]).filter("a < b").unionByName(side(removed, "a").join(side(_own(valued), "b"), ["value", "half"]))
    first = (F.length("b") / 2).cast("int")
    same_first = F.substring("a", F.lit(1), first) == F.substring("b", F.lit(1), first)
    return joined.filter((F.col("side") == 0) | ~same_first).filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near (how many near words it has), form and form_n (its commonest near word's, if that is common enough)."""
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct("a", "b", F.col("b_n").alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("a_n").alias("n")))).alias("p")).select("p.a", "p.b", "p.n")
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
    joined = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    common = F.col("best_n") >= F.col("n") * factor
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.b")).alias("form"), F.when(common, F.col("best_n")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word and root of the words that have a form. formed: word, form; chains of forms don't come back to a word.

    As many rounds as the logarithm of the longest chain. A word has some thousands of near words at most, which bounds
    how many share a root's row in a join; AQE splits what is uneven.
    """
    up = cut(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = cut(up.join(higher, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        up = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return up


def group_variants(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lose_one_in: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR
) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of enough letters and occurrences."""
    if min_length < 2:
        raise ValueError("words of one letter have no halves")
    words = cut(count_words(df, text_col, id_col, lose_one_in, min_length, min_count))
    formed = cut(forms(words, factor))
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
