"""The unigram score and the mixed model against plain Python, the model as a distribution, and on texts it hasn't learned from."""

from __future__ import annotations

import math
import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute, brute_lm
from tests.llm.test_operators import docs, items, table  # noqa: F401
from tracelake.llm import lm_scoring, mixer


def test_base_and_score(spark, table, docs):  # noqa: F811
    rows = lm_scoring.score(table).collect()
    want = brute.unigram(docs)
    key = lambda x: (repr(x[0]), x[1:5])
    got = sorted((tuple(r)[:6] for r in rows), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert any(r.held_out for r in rows) and all(r.score < 0 for r in rows)
    size = dict((d, len((t or "").encode()) + 1) for d, t in docs)
    assert all(r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / size[r.doc_id]) for r in rows if r.doc_id is not None)


def test_held_out_bits_per_byte(spark):
    """Texts not learned from, of which none like them was: under the unigram, which codes no white space, nor unknown words by their letters."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    own = {r.doc_id: len((r.text or "").encode()) + 1 for r in df.collect()}
    rows = [r for r in lm_scoring.score(df).collect() if r.held_out and own[r.doc_id] > 300 and r.bits_per_byte > 1]
    bytes_ = sum(own[r.doc_id] for r in rows)
    bits = -sum(r.score for r in rows) / math.log10(2) / bytes_
    unigram = -sum(r.base_score for r in rows) / math.log10(2) / bytes_
    assert len(rows) > 1000 and bits < 2.1 and bits < 0.97 * unigram


@pytest.fixture(scope="module")
def model():
    """A model of syllables, with weights learned from texts that the tables don't know."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["ta", "ro", "lin", "é", "x"], [5, 3, 2, 1, 1], k=rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 300))).replace("x ", "x\n") for _ in range(90)]
    train, teach, rest = texts[:60], texts[60:80], texts[80:]
    stream = lambda ts: [mixer.Stream(d, o, e) for _, d, o, e in mixer.runs(pa.array(ts))]
    grams: dict = {}
    for s in stream(train):
        for b, x in zip((s.before >> np.uint64(40)).tolist(), s.symbol.tolist()):
            grams[b, x] = grams.get((b, x), 0) + 1
    contexts = sorted({b for b, _ in grams if b % 3})  # some have no tree
    pairs = np.zeros((256, 256), np.int64)
    for (b, x), n in grams.items():
        pairs[b >> 16, x] += n
    code = mixer.Code(np.array(contexts), np.array([(contexts.index(b), x, n) for (b, x), n in grams.items() if b % 3 and n > 1]), pairs)
    counts = mixer.empty()
    mixer.count(code, counts, iter(stream(train)), most=5000)
    tables = [mixer.logits(c.reshape(-1, 2)) for c in counts]
    teacher = mixer.Teacher()
    for s in stream(teach):
        teacher.learn(code, tables, s)
    return pickle.loads(pickle.dumps(code)), tables, mixer.taught(teacher.w.weights * teacher.n[:, None], teacher.n, teacher.seen), train, rest


def test_bits_against_plain_python(model):
    code, tables, w, train, rest = model
    texts = [*rest, train[0], "", "A", "never seen ØÞ 12345 " * 30, " \n\t "]
    got = np.zeros(len(texts))
    for at, data, offsets, ended in mixer.runs(pa.array(texts)):
        s = mixer.Stream(data, offsets, ended)
        cost = mixer.segment_costs(code, tables, w, s)
        assert len(cost) == len(s.segment_row) and (np.bincount(s.segment) > 0).all()
        got[at : at + len(offsets) - 1] += np.bincount(s.segment_row, cost, len(offsets) - 1)
    want = [brute_lm.bits(code, tables, w, t.encode()) for t in texts]
    assert got == pytest.approx(want, rel=2e-4)


def test_learned_weights_help(model):
    code, tables, w, _, rest = model
    s = [mixer.Stream(d, o, e) for _, d, o, e in mixer.runs(pa.array(rest))]
    bits = lambda w: sum(mixer.segment_costs(code, tables, w, x).sum() for x in s)
    assert bits(w) < bits(mixer.Weights(w.weights)) < bits(mixer.Weights())


def test_it_is_a_distribution(model):
    """Probabilities of all symbols after some bytes sum to one: those of the own tree and escape, and of the tree of the last byte."""
    code, tables, w, _, _ = model
    for before in (b"\xfe" * 8, b"tarolin ", b"ZZZZtaro"):
        p = {x: math.prod(p for p, _ in brute_lm.predict(code, tables, w, [0.0] * 3, before, x)) for x in range(256)}
        tree = int(code.tree[before[-1] << 16 | before[-2] << 8 | before[-3]])
        own = [x for x in range(256) if code.path[tree, x]]
        escaped = [p[x] for x in range(256) if x not in own]
        assert sum(p[x] for x in own) + sum(escaped) <= 1 + 1e-9
        assert sum(p[x] for x in own) + sum(escaped) > (0.999 if not own else 0.5)


def test_counts_are_packed_exactly():
    rng = np.random.default_rng(2)
    counts = (rng.integers(0, 3, 2 * lm_scoring.PIECE) * rng.integers(0, 300, 2 * lm_scoring.PIECE)).astype(np.uint32)
    assert (lm_scoring.unpack(lm_scoring.pack(counts)) == counts).all()


def test_lookup():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64) << np.uint64(2 if rng.integers(2) else 1))
    keys[:2000] >>= np.uint64(40)  # many in the same slots
    keys = np.unique(keys)
    found = pickle.loads(pickle.dumps(mixer.Lookup(keys)))
    other = rng.integers(0, 1 << 62, 5000).astype(np.uint64) | np.uint64(1)
    assert (found.find(keys) == np.arange(len(keys))).all()
    assert [x >= 0 for x in found.find(other)] == [int(x) in set(keys.tolist()) for x in other]


def passages(spark, held=2):
    """Texts of their own; two that hold the same; and one that is held out and holds what another does."""
    import zlib

    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400))
    out = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == held]
    ins = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 not in (held, held + 1)]
    same, other = own(), own()
    rows = [(i, own()) for i in ins[:40]] + [(ins[40], same), (ins[41], same), (ins[42], other), (out[0], other), (out[1], own()), (out[2], other + " " + own())]
    return rows, ins, out


def test_segments_that_were_seen(spark):
    rows, ins, out = passages(spark)
    r = {r.doc_id: r.bits_per_byte for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone = [r[i] for i in (*ins[:40], ins[42], out[1])]
    assert max(r[i] for i in (ins[40], ins[41], out[0])) < 0.5 * min(alone)  # copies that were learned from
    assert r[out[0]] < r[out[2]] < 0.7 * r[out[1]]  # held out: all, half and nothing of it was seen


def test_gain():
    """By the formula: two segments of a context seen three times, the second after the first held; own ones don't count."""
    rates = [0.5, 0.7, *[0.9] * 4]
    one = (1, 2, 40.0, 3, 3)
    first = math.log2(0.7 + 0.3 * 2.0**-40) + 40
    assert lm_scoring.gain([one], True, rates) == pytest.approx(first)
    shift = lm_scoring.BELIEF * (0.7 / (0.7 + 0.3 * 2.0**-40) - 0.7)
    belief = 1 / (1 + math.exp(-(math.log(0.7 / 0.3) + shift)))
    other = (5, 6, 30.0, 0, 2)
    assert lm_scoring.gain([one, other], True, rates) == pytest.approx(first + math.log2(1 - belief))
    assert lm_scoring.gain([(1, 2, 40.0, 1, 1)], False, rates) == 0
    half = math.log2(0.5 + 0.5 * 2.0**-40) + 40
    assert lm_scoring.gain([(1, 2, 40.0, 2, 2)], False, rates) == pytest.approx(half)
    # Of two of its own, the second knows the first.
    assert lm_scoring.gain([(1, 2, 40.0, 2, 2)] * 2, False, rates) == pytest.approx(half)


def test_very_long_texts(model):
    """Megabytes, with and without blanks, are scored whole in pieces, in little more memory than the text."""
    code, tables, w, train, _ = model
    unit = " ".join(train)
    text = (unit + " ") * (4_000_000 // len(unit) + 1)
    short = sum(mixer.segment_costs(code, tables, w, mixer.Stream(d, o, e)).sum() for _, d, o, e in mixer.runs(pa.array([text[: len(text) // 4]])))
    column = pa.array([text])
    tracemalloc.start()
    cost, symbols = 0.0, 0
    for _, data, offsets, ended in mixer.runs(column):
        s = mixer.Stream(data, offsets, ended)
        cost += mixer.segment_costs(code, tables, w, s).sum()
        symbols += len(s.symbol)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert symbols == len(text.encode()) + 1 and cost == pytest.approx(4 * short, rel=0.02) and peak < 150e6
    blob = mixer.runs(pa.array(["q" * 400_000]))
    assert sum(len(mixer.Stream(d, o, e).symbol) for _, d, o, e in blob) == 400_001


def test_empty(spark, table):  # noqa: F811
    assert lm_scoring.score(table.limit(0)).collect() == []


def test_all_held_out(spark):
    rows = [(d, "some words") for d in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").where(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    out = lm_scoring.score(df).collect()
    assert out and {(r.n_known, r.train_tokens) for r in out} == {(0, 0)}
