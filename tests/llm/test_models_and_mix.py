"""Toxicity, language and mixing: planted signals, held-out accuracy and sums."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from conftest import SCHEMA, WORD, make_docs
from pyspark.sql import functions as F
from test_ngram_join import brute

from folioflow.llm import language_id, mixing, quality_rules, toxicity

DATA = "/root/testdata/sf0.01"


def toxic_corpus(n=240):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        sentences = [" ".join(rng.choice(["calm", "river", "stone", "green", "walk"]) for _ in range(6)) + "." for _ in range(5)]
        bad = k % 4 == 0
        if bad:
            sentences[2] = f"you {rng.choice(['vile', 'rotten'])} {rng.choice(['fool', 'wretch'])} leave."
        rows.append((k, " ".join(sentences), "en", "a", 0))
        labels.append((k, int(bad)))
    return rows, labels


def test_offending_sentences_are_found(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + [(9000, None, None, None, 0), (9001, "", None, None, 0)], SCHEMA).withColumns({"score": F.lit("x"), "offending": F.lit(1)})
    model = toxicity.fit(docs, spark.createDataFrame(labels[:160], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for k, text, *_ in rows[160:]:
        assert (got[k].score >= 0.5) == (k % 4 == 0)
        if k % 4 == 0:
            assert any("leave" in text[s.start : s.end] for s in got[k].offending)
    assert got[9000].score == got[9001].score == 0 and got[9000].offending == []


def test_noisy_or_in_plain_python(spark):
    """Scores and spans from a model's weights, sentence by sentence; combining marks and letters that change length included."""
    rows, labels = toxic_corpus(120)
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = ["You vile fool. Calm river!", "", "\u0130stanbul vile. cafe\u0301 rotten\nwretch", "12 34. ...", "vile " * 4000]
    got = toxicity.score(spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA), model).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        clean, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]*(?:[.!?\n]+|$)", low):
            words = re.findall(r"[^\W\d_]+", m.group())
            if words:
                own = set().union(*(toxicity.word_places(w) for w in words)) & set(model.weights)
                p = 1 / (1 + math.exp(-(model.bias + sum(model.weights[k] for k in own))))
                clean *= 1 - p
                if p >= 0.5:
                    spans.append((m.start(), m.end()))
        assert row.score == pytest.approx(1 - clean, abs=1e-9) and [(s.start, s.end) for s in row.offending] == spans


def test_samples_are_bounded(spark):
    from folioflow.llm.common import bounded_sample

    repeated = spark.range(50).selectExpr("cast(null as long) AS id", "'same' AS text").union(spark.range(30).selectExpr("id", "'t' AS text"))
    assert bounded_sample(repeated, 20).count() == 20 and bounded_sample(repeated, 500).count() == 80
    assert sorted(map(str, bounded_sample(repeated, 20).collect())) == sorted(map(str, bounded_sample(repeated.repartition(7), 20).collect()))
    assert bounded_sample(repeated.limit(0), 20).count() == 0


def test_toxicity_without_labels(spark, docs, no_docs):
    for labels in ([], [(1, 0), (2, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.score(docs, model).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(no_docs, model).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_language_on_held_out_rows(spark):
    from folioflow.llm.queries import op8_language

    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    judged = op8_language(spark, DATA).join(truth, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = judged.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right / n > 0.9


def test_language_edges(spark, no_docs):
    rows = [(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * 5, "de" if k % 2 else "en", "a", 0) for k in range(40)]
    train = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(train)
    texts = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (3, "123 !?", None, None, 0), (4, "the dog and the cat", None, None, 0), (5, "der hund und die katze " * 5000, None, None, 0)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(texts, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[5][0] == "de"
    assert language_id.fit(no_docs) is None
    assert {r.lang_pred for r in language_id.predict(texts, None).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


def levelled(sizes):
    """Targets by sharing what is above twice a size again and again."""
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x)))}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        left, weight = total - sum(target.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > 2 * sizes[s]]
        if not over:
            target |= {s: left * weights[s] / weight for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(k, "word " * rng.randint(0, 300), None, rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for k in range(400)] + [(7, "word " * 50, None, "a", 0)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("x"), "target": F.lit(0), "key": F.lit(1), "bucket": F.lit(2)})
    got = mixing.taken(*mixing.mix(docs)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    want = levelled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 3 * mixing.BLOCK_TOKENS
    again = mixing.taken(*mixing.mix(docs.repartition(7))).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_resample(docs, no_docs):
    out = mixing.resample(docs.withColumn("size", F.lit("mine")))
    assert out.columns == [*docs.columns, "size"] and out.filter("text IS NULL").count() == 0
    assert mixing.resample(no_docs).count() == 0 and mixing.taken(*mixing.mix(no_docs)).count() == 0


def clashing(df):
    names = ("__size", "__time", "size", "key", "place", "row", "times", "last0", "bucket", "id", "of", "comp", "found", "n_words")
    return df.withColumns({n: F.lit("mine") for n in names}), names


def test_resample_with_clashing_names(docs):
    wide, names = clashing(docs)
    rows = mixing.resample(wide)
    assert rows.columns == wide.columns and rows.count() > 0
    assert {tuple(r[n] for n in names) for r in rows.collect()} == {("mine",) * len(names)}


@pytest.mark.parametrize("bytes_", [mixing.BROADCAST_BYTES, 0])
def test_resample_reads_as_often_as_the_pieces(docs, monkeypatch, bytes_):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", bytes_)
    _, pieces = mixing.mix(docs)
    want = {(r.doc_id, r.source, r["size"]): r.times for r in pieces.groupBy("doc_id", "source", "size").agg(F.countDistinct("repeat").alias("times")).collect()}
    rows = [r for r in make_docs() if len(WORD.findall(r[1] or ""))]
    expected = Counter()
    for r in rows:
        expected[r[0], r[1], r[3]] += want.get((r[0], r[3], len(WORD.findall(r[1]))), 0)
    assert Counter((r.doc_id, r.text, r.source) for r in mixing.resample(docs).collect()) == +expected


def plain_pipeline(rows):
    """The documents that quality rules and near duplicates leave, in plain Python; the text has no private values."""
    good = []
    for r in rows:
        text = r[1] or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        n = {
            "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_stop_words": sum(w.lower() in quality_rules.ALL_STOP_WORDS for w in words),
            "n_lines": len(lines), "lines_and_4": len(lines) + 4, "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}), "one": 1,
        }
        n["latin_words_past_50"] = n["n_words"] - 50 if 2 * len(re.findall("[A-Za-z]", text)) >= n["word_chars"] else 0
        if all((n[x.measure] * 100 <= x.factor * n[x.base]) if x.sign == "<=" else (n[x.measure] * 100 >= x.factor * n[x.base]) for x in (*quality_rules.BASE_RULES, *quality_rules.THRESHOLDS)):
            good.append(r)
    kept, seen = [], set()
    for r, (ident, size, component) in zip(good, brute(good)):
        if (not size or ident == component) and (ident, r[1]) not in seen:
            seen.add((ident, r[1]))
            kept.append(r)
    return good, kept


def test_pipeline(spark, tmp_path):
    """All stages of run() on a small folder against plain Python."""
    import corpus_pipeline
    import sentencepiece

    from folioflow.llm.queries import tokenizer_path

    rng = random.Random(8)
    filler = [*"the of and to in is that it".split(), *(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10))]
    rows = [(k, " ".join(rng.choice(filler) for _ in range(rng.randint(15, 90))), "en", rng.choice(["a", "b", None]), 0) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " tail" * (k % 2), "en", "a", 0) for k in range(0, 30, 3)] + [rows[5], (None, rows[7][1], "en", "b", 0), (201, None, None, None, None), (202, "", "en", "a", 0), (203, "# $ % " * 30, "en", "a", 0), (204, "same words here again and again\n" * 20, "en", "b", 0)]
    # With plain ids alone the least id of a group is its first row's.
    rows = [r for r in rows if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good, kept = plain_pipeline(rows)
    assert 0 < len(kept) < len(good) < len(rows)
    kept_frame = spark.createDataFrame(kept, SCHEMA)
    _, pieces = mixing.mix(kept_frame)
    times = {r.doc_id: r.times for r in pieces.groupBy("doc_id").agg(F.countDistinct("repeat").alias("times")).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = Counter()
    for r in kept:
        want[r[0], (*library.encode(r[1]), library.eos_id())] += times.get(r[0], 0)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == +want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_pipeline_stages_keep_columns(spark, docs, no_docs):
    import corpus_pipeline

    wide, names = clashing(docs)
    for start in (wide, no_docs):
        current = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            current = stage(spark, current, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert current.columns == start.columns
        assert bool(current.collect()) == (start is wide)


def test_docs_fixture_has_the_cases():
    texts = [r[1] for r in make_docs()]
    assert None in texts and "" in texts and max(len(t or "") for t in texts) > 50_000
