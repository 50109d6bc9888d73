"""Training on all rows against training on a sample, against plain descent, and with variants of rows kept together."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.operators import classify, training
from tracelake.plans import registry

WORDS = {"calm": "gentle quiet steady careful ready tidy".split(), "rough": "broken angry crash failed panic noisy".split()}


def rows(n=300, noise=0.1):
    rng = random.Random(8)
    out = []
    for i in range(n):
        label = rng.choice(["calm", "calm", "rough"])
        own = WORDS[label] if rng.random() > noise else WORDS["calm" if label == "rough" else "rough"]
        out.append((i, " ".join(rng.choice(own + ["the", "a", "of", "work"]) for _ in range(8)), label, i // 3))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows() + [(900, None, "calm", 1), (901, "other", "neither", 1)], "id long, text string, label string, seed long").repartition(5).cache()


def test_as_good_as_on_a_sample(spark, table):
    ours = training.train_all(table, "text", "label", ("calm", "rough"), folds=3)
    theirs = classify.train(table, "text", "label", ("calm", "rough"), folds=3)
    assert ours["accuracy"] >= theirs["accuracy"] - 0.02 and ours["accuracy"] > 0.8
    assert ours["word"]["vocabulary"] == theirs["word"]["vocabulary"] and ours["word"]["idf"] == pytest.approx(theirs["word"]["idf"])
    assert ours["char"]["vocabulary"] == theirs["char"]["vocabulary"]
    # The same minimum, found another way.
    a, b = (np.array(m["word"]["weights"] + m["char"]["weights"] + [m["bias"]]) for m in (ours, theirs))
    assert np.corrcoef(a, b)[0, 1] > 0.98
    run = classify.classifier(spark, {"mood": ours})
    labelled = table.where("label <> 'neither' AND text IS NOT NULL")
    assert labelled.where(run(F.col("text"))["mood"] == F.col("label")).count() > 0.85 * labelled.count()


def test_variants_of_a_row_share_a_fold(spark):
    """Texts whose labels are chance: who has seen a variant of a row knows its label, who hasn't can't."""
    rng = random.Random(2)
    out = []
    for seed in range(60):
        label, own = rng.choice(["calm", "rough"]), [f"w{rng.randrange(10**6)}" for _ in range(6)]
        out += [(" ".join(rng.sample(own, 5)), label, seed) for _ in range(4)]
    df = spark.createDataFrame(out, "text string, label string, seed long")
    leaky, held = (training.train_all(df, "text", "label", ("calm", "rough"), group=g, folds=4, rounds=25)["accuracy"] for g in (None, "seed"))
    assert leaky > 0.9 and held < 0.75


def test_without_rows_and_with_one_class(spark):
    none = training.train_all(spark.createDataFrame([], "text string, label string"), "text", "label", ("calm", "rough"))
    assert none["bias"] == 0.0 and none["word"]["vocabulary"] == {}
    one = training.train_all(spark.createDataFrame([("all calm here",)] * 4, "text string").withColumn("label", F.lit("calm")), "text", "label", ("calm", "rough"), most_docs=1.0)
    assert classify.predict(one, "all calm here")[0] == "calm"


def test_descent_finds_the_least():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12))
    h, b = a.T @ a + np.eye(12), rng.normal(size=12)
    d = training.Descent(12, tolerance=1e-9)
    for _ in range(200):
        d.told(float(d.trial @ h @ d.trial / 2 - b @ d.trial), h @ d.trial - b)
        if d.done:
            break
    assert d.x == pytest.approx(np.linalg.solve(h, b), abs=1e-5)


def test_grams_are_counted_as_by_hand(spark):
    """Counts of a task against plain ones, for words that repeat, hold a gram twice, or are no words; in several batches of counts."""
    texts = ["aaa bbb aaa", "", "ÄB äb Ab_1 aaa!", "the THE  the\n", "x" * 50 + " aaaa", "日本 日本語 ſ K"]
    for text in texts:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"\w+", text)]
        assert classify.word_grams(text, 1, 2) == Counter(" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1))
        assert classify.char_grams(text, 3, 5) == Counter(f" {w} "[i : i + n] for w in text.lower().split() for n in (3, 4, 5) for i in range(len(w) + 3 - n))
    counts = training.Counts((1, 2), (3, 5))
    for text in texts * 2:
        counts.add(text)
    have = {(p, g): (d, t) for b in counts.out() for p, g, d, t in zip(*(b.column(i).to_pylist() for i in range(4)))}
    word, char = (Counter(g for t in texts * 2 for g in f(t, *r)) for f, r in ((classify.word_grams, (1, 2)), (classify.char_grams, (3, 5))))
    total = sum((classify.char_grams(t, 3, 5) for t in texts * 2), Counter())
    assert have == {("word", g): (n, n) for g, n in word.items()} | {("char", g): (n, total[g]) for g, n in char.items()}


def test_labels_share_passes(spark, table, monkeypatch):
    """Models of two labels at once are those that each gets alone, from one count of the grams."""
    both = table.where("label <> 'neither'").withColumn("odd", F.when(F.col("seed") % 2 == 1, "rough").otherwise("calm"))
    made, count = [], training.vocabulary
    monkeypatch.setattr(training, "vocabulary", lambda *a, **k: made.append(1) or count(*a, **k))
    two = training.train_each(both, "text", ["label", "odd"], ("calm", "rough"), folds=2, rounds=6)
    assert len(made) == 1
    for model, label in zip(two, ("label", "odd")):
        one = training.train_all(both, "text", label, ("calm", "rough"), folds=2, rounds=6)
        assert one["accuracy"] == pytest.approx(model["accuracy"], abs=0.02) and one["word"]["idf"] == model["word"]["idf"]
        assert one["word"]["weights"] == pytest.approx(model["word"]["weights"], abs=0.01)


def test_a_model_without_grams_counts_none(monkeypatch):
    monkeypatch.setattr(classify, "char_grams", None)
    part = {"vocabulary": {"fix": 0}, "idf": [1.0], "weights": [2.0], "ngram_range": [1, 1], "binary": True, "sublinear_tf": True}
    none = {"vocabulary": {}, "idf": [], "weights": [], "ngram_range": [3, 5], "binary": False, "sublinear_tf": True}
    assert classify.predict({"classes": ["a", "b"], "word": part, "char": none, "bias": 0.0}, "Fix it")[0] == "b"


def test_a_word_that_comes_again_is_cut_once():
    classify._cut.cache_clear()
    assert classify.char_grams("Abc abc abc", 3, 3)["abc"] == 3 and classify._cut.cache_info().misses == 1


def test_pairs_to_measure_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(x):
        seen.add(1)
        return "good" if x % 3 else "poor"

    pairs = spark.range(40).select(F.when(F.col("id") % 2 == 0, "good").otherwise("poor").alias("expected"), said("id").alias("predicted"))
    got = {r["class"]: r.tp for r in classify.measures(pairs).collect()}
    assert got == {"good": sum(i % 2 == 0 and i % 3 > 0 for i in range(40)), "poor": sum(i % 2 > 0 and i % 3 == 0 for i in range(40))}
    assert seen.value == 40


def test_scorer_gives_what_predict_gives_and_cuts_a_word_once(monkeypatch):
    rng = random.Random(3)
    words = ["Fix", "fix", "the", "lamp", "É.é", "a", "_b", "x" * 40, "o'clock"]
    texts = ["", "  ", "unheard", *(" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(60))]

    def part(counts, n, binary, sublinear):
        known = sorted({g for t in texts for g in counts(t, *n)})[::2]
        return {"vocabulary": {g: i for i, g in enumerate(known)}, "idf": [1 + rng.random() for _ in known], "weights": [rng.gauss(0, 1) for _ in known], "ngram_range": list(n), "binary": binary, "sublinear_tf": sublinear}

    for binary, sublinear in ((True, True), (False, True), (False, False)):
        model = {"classes": ["no", "yes"], "word": part(classify.word_grams, (1, 2), binary, sublinear), "char": part(classify.char_grams, (3, 5), binary, sublinear), "bias": 0.1}
        want = [classify.predict(model, t) for t in texts]
        with monkeypatch.context() as m:
            cuts, cut = [], classify.cut
            m.setattr(classify, "cut", lambda w, lo, hi: cuts.append(w) or cut(w, lo, hi))
            score = classify.Scorer(model)
            got = [score(t) for t in texts]
            short = [w for w in cuts if len(w) <= classify.LONG]
            assert len(short) == len(set(short)) and "lamp" in short
        assert [a for a, _ in got] == [a for a, _ in want] and all(math.isclose(a, b) for (_, a), (_, b) in zip(got, want))


def test_the_query_learns_from_all_rows_but_the_fourth(spark, tmp_path, monkeypatch):
    """More rows than the bounded sample of ``classify.train``: the grams' weights tell of how many texts they were counted."""
    n = 3200
    own = lambda i: WORDS["calm" if i % 3 else "rough"]
    spark.createDataFrame([(i, f"{own(i)[i % 6]} {own(i)[i % 5]}" + " seldom" * (i % 400 == 1)) for i in range(n)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    made, score = [], classify.classifier
    monkeypatch.setattr(classify, "classifier", lambda s, models: made.append(models["quality"]) or score(s, models))
    got = {r["class"]: r for r in registry.QUERIES["classifier_trained"](spark, str(tmp_path)).collect()}
    word = made[0]["word"]
    assert word["idf"][word["vocabulary"]["seldom"]] == pytest.approx(math.log((1 + n * 3 / 4) / (1 + n / 400)) + 1)
    assert {k: r.tp for k, r in got.items()} == {"good": sum(i % 3 > 0 for i in range(0, n, 4)), "poor": sum(i % 3 == 0 for i in range(0, n, 4))}


def test_blocks_give_what_full_rows_give():
    """Margins and sums of sparse vectors, several blocks of them, against plain products."""
    rng = np.random.default_rng(4)
    rows, width, weights = 2 * training.ROWS + 3, 12, rng.normal(size=(3, 12))
    full = np.where(rng.random((rows, width)) < 0.3, rng.normal(size=(rows, width)), 0).astype(np.float32)
    full[:, -1] = 1
    at = [np.flatnonzero(x).astype(np.int32) for x in full]
    by = rng.normal(size=(rows, 3))
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0, -1.0]] * rows), pa.array(range(rows), pa.int32()), pa.array([x.tobytes() for x in at]), pa.array([x[i].tobytes() for x, i in zip(full, at)])], ["y", "fold", "indices", "values"])
    blocks = list(training._blocks(batch))
    assert np.concatenate([b.fold for b in blocks]).tolist() == list(range(rows)) and all(b.y.shape == (len(b.fold), 2) for b in blocks)
    assert np.concatenate([b.margins(weights) for b in blocks]) == pytest.approx(full @ weights.T, abs=1e-6)
    assert sum(b.weighed(by[b.fold], width) for b in blocks) == pytest.approx(by.T @ full, abs=1e-5)
    assert list(training._blocks(batch.slice(0, 0))) == []


def test_a_word_is_cut_at_all_places():
    for word in ("", "a", "abc", "日本", "x" * classify.LONG, "x" * (classify.LONG + 1)):
        w = f" {word} "
        for lo, hi in ((3, 5), (1, 1), (5, 5), (2, 9)):
            assert classify.cut(word, lo, hi) == tuple(w[i : i + n] for n in range(lo, hi + 1) for i in range(len(w) - n + 1))


def test_many_texts_cut_at_once_give_what_each_gives():
    """Also with so many characters that a gram's number has to be made smaller, and without grams."""
    wide = " ".join("".join(chr(0x4E00 + 7 * i + k) for k in range(7)) for i in range(1400))
    texts = ["aaa bbb aaa", "", "ab\x00 \x00 a", "日本 K ſ aaa", wide, "aaa " + wide[:900], " \n "]
    for lo, hi in ((3, 5), (1, 2), (2, 7)):
        want = [classify.char_grams(t, lo, hi) for t in texts]
        names, text, gram, often = classify.char_places(texts, lo, hi)
        got = [Counter() for _ in texts]
        for t, g, n in zip(text.tolist(), gram.tolist(), often.tolist()):
            got[t][names[g]] += n
        assert got == want and len(names) == len(set(names))
    _, text, gram, often = classify.char_places(texts, 3, 5, {"aaa": 7, "none": 1})
    assert sorted(zip(text.tolist(), gram.tolist(), often.tolist())) == [(0, 7, 2), (3, 7, 1), (5, 7, 1)]
    assert [len(x) for x in classify.char_places(["", " "], 3, 5, {})] == [0] * 4 and [len(x) for x in classify.char_places([], 3, 5)] == [0] * 4
