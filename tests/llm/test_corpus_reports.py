"""Periodic runs, token counts and the source audit against plain Python and the tokenizer's library; hard cases and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import divergence, runs, token_counts

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, runs string, n int, changes binary, term string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    more = [None, "", " \n\t", "one", "a a a a a a", "a b " * 40 + "c", "x " + "a b a b a c " * 9, "É é ﬀ Ａ ▁▁ \U0001f600\u0000<s> </s>", "the " * 3000, "no" * 4000, " " * 500, "q w e r t y " * 4 + "q w e", "A b A b A b A b A b a B"]
    rows = base + [(10_000 + i, t, [None, "", "en"][i % 3], [None, "src0", "Z", "\U0001f600"][i % 4]) for i, t in enumerate(more)]
    rows += [rows[3], rows[3], (None, "a b a b a b a b a b", "en", None), (None, None, "xx", "only")]
    return rows


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame([(*r, "x", 1, b"y", "z") for r in docs], SCHEMA).repartition(7).cache()


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def brute_runs(s, least, times):
    found = []
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            w = s[i : i + p]
            if j - i + p >= max(least, times * p) and not any(p % q == 0 and w == w[:q] * (p // q) for q in range(1, p)):
                found.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_runs_of_random_letters():
    rng = random.Random(5)
    for _ in range(1500):
        kinds = rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(kinds) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            w = [rng.randrange(kinds) for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(s))
            s[at:at] = w * rng.randint(2, 8) + w[: rng.randint(0, len(w))]
        for least, times in ((6, 4), (2, 2), (9, 3)):
            assert runs.runs(np.array(s, np.int32), least, times) == brute_runs(s, least, times), s


def test_long_repetitive_texts_take_linear_time():
    """A million words each: comparisons that started anew would take hours."""
    n = 1_000_000
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < n:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs.runs(np.zeros(n, np.int32)) == [(0, n, 1)]
    assert runs.runs(np.array([1, 2] * (n // 2) + [0], np.int32)) == [(0, n, 2)]
    assert runs.runs(np.array(fibonacci[-1][:n], np.int32)) == []  # its runs have under four periods
    assert runs.runs(np.arange(n, dtype=np.int32)) == []


def test_periodic_runs(spark, table, docs, monkeypatch):
    monkeypatch.setattr(runs, "BATCH", 2000)
    want = []
    for doc, text, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        found = brute_runs(w, 6, 4)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        want.append((doc, len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sum(x[1] > 0 for x in want) > 8 and max(x[1] for x in want) > 1
    table.write.mode("overwrite").parquet(path := f"{runs_folder(spark)}/documents.parquet")
    same(runs.op11_periodic_runs(spark, path.rpartition("/")[0]), want)


def runs_folder(spark):
    import tempfile

    return tempfile.mkdtemp(prefix="tables-")


def test_runs_of_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(runs.textcore, "CHUNK", 64)
    monkeypatch.setattr(runs, "JOINED", 5)
    text = " ".join(random.Random(1).choice(["a", "bb", "é" * 50, "d" * 200]) for _ in range(500)) + "\n"
    ids, words = runs.numbered_words(text.encode())
    assert runs.joined(ids, words).decode() == " ".join(text.split())


def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))


def test_token_counts(table, docs):
    model = library()
    n = [len(model.encode(t or "")) for _, t, *_ in docs]
    out = token_counts.token_counts(table, limit=400).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted((d or 0, len((t or "").encode()), x, x > 400) for (d, t, *_), x in zip(docs, n))
    of = {r.doc_id: r.chars_within for r in out}
    for doc, text, *_ in docs:
        if doc is not None and doc >= 10_000:
            text = text or ""
            assert of[doc] == max(i for i in range(min(len(text), 4000) + 1) if len(model.encode(text[:i])) <= 400)


def test_stored_prefix_counts(spark, table, docs):
    model = library()
    stored = token_counts.prefix_counts(table)
    at = stored.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("i"), "changes")
    texts = {d: t or "" for d, t, *_ in docs if d is not None}
    got = at.select("doc_id", "i", token_counts.count_at("changes", "i").alias("n")).where(F.col("doc_id").isNotNull()).collect()
    for r in got:
        assert r.n == len(model.encode(texts[r.doc_id][: r.i])), r
    fit = stored.select("doc_id", token_counts.longest_within("changes", 5).alias("n")).where("doc_id >= 10000").collect()
    for r in fit:
        t = texts[r.doc_id]
        assert r.n == max(i for i in range(min(len(t), 200) + 1) if len(model.encode(t[:i])) <= 5)


def test_prefixes_of_random_texts(monkeypatch):
    model, units = library(), token_counts.units(None)
    monkeypatch.setattr(token_counts, "CHUNK", 7)  # units go over the cuts
    monkeypatch.setattr(token_counts, "KEPT", 20)  # what is kept is often dropped
    rng = random.Random(2)
    for _ in range(400):
        s = "".join(rng.choice("ab the\n▁▁ é漢字本<s>0x0A>12\U0001f600’., ing") for _ in range(rng.randint(1, 40)))
        assert units.of(s.encode()).astype(int).cumsum().tolist() == [len(model.encode(s[:i])) for i in range(1, len(s) + 1)], s


def test_other_models_are_refused(tmp_path):
    import sentencepiece

    with pytest.raises((ValueError, OSError, RuntimeError)):
        token_counts.units(str(tmp_path / "none.model"))
    assert sentencepiece  # a model file is never made here: tokenizers are not trained


def brute_audit(docs, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = []
    for lang in df:
        kept = {t for t, c in df[lang].items() if c >= least}
        groups = {s: {t: c for t, c in x.items() if t in kept} for (g, s), x in n.items() if g == lang}
        total = Counter()
        for x in groups.values():
            total.update(x)
        p = {s: {t: 1 + 10**9 * (x.get(t, 0) + 1) // (sum(x.values()) + len(kept)) for t in kept} for s, x in groups.items()}
        q = {t: 1 + 10**9 * (total[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in groups:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s]
            own = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in groups[s] if p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", own, top)):
                out += [(lang, s, part, t, v, i) for i, (t, v) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return out


@pytest.mark.parametrize("least,top", [(3, 200), (1, 3)])
def test_source_audit(table, docs, least, top):
    want = brute_audit(docs, least, top)
    assert len(want) > 300
    same(divergence.audit(table, least=least, top=top), want)


def test_source_audit_shuffled(table, docs, monkeypatch):
    """Joins without a broadcast, and a round for each few terms."""
    from tracelake.llm import common

    monkeypatch.setattr(divergence, "GROWTH", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    same(divergence.audit(table, top=7), brute_audit(docs, 3, 7))


def test_source_audit_in_pieces(docs, monkeypatch):
    """Counts handed on early, texts in slices, pairs in blocks, postings of a term over several batches."""

    def batches(rows, names, n):
        return [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + n]]) for i in range(0, len(rows), n)]

    def added(found, keys):
        out = Counter()
        for r in (r for b in found for r in b.to_pylist()):
            out[tuple(r[k] for k in keys)] += r.get("value", r.get("n"))
        return {k: v for k, v in out.items() if v}

    rows = [(lang or "", source or "", text or "") for _, text, lang, source in docs]
    postings = sorted((f"l{i % 2}", f"s{i % 11}", f"t{i % 29}", 5 + i, 3 + i % 7) for i in range(300))
    postings = sorted({x[:3]: x for x in postings}.values(), key=lambda x: (x[0], x[2]))
    names = ["lang", "source", "term", "p", "p0"]
    counted, both = (lambda n: added(divergence._counted(iter(batches(rows, ["lang", "source", "text"], n))), ["lang", "source", "term"])), (lambda n: added(divergence._both(iter(batches(postings, names, n))), ["lang", "source", "item"]))
    whole = counted(10_000), both(10_000)
    assert len(whole[0]) > 1000 and len(whole[1]) > 50
    monkeypatch.setattr(divergence, "COUNTED", 50)
    monkeypatch.setattr(divergence, "CHUNK", 16)
    monkeypatch.setattr(divergence, "PAIRS", 3)
    assert (counted(9), both(7)) == whole


def test_counts_of_a_large_corpus_are_exact(spark):
    n, total, kinds = 7 * 10**12, 10**14 + 1, 10**7
    row = spark.createDataFrame([(n, total, kinds)], "n long, total long, kinds long")
    assert row.select(divergence.share(F.col("n"), F.col("total"), F.col("kinds"))).first()[0] == 1 + 10**9 * (n + 1) // (total + kinds)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert runs.periodic_runs(none).collect() == token_counts.token_counts(none).collect() == token_counts.prefix_counts(none).collect() == divergence.audit(none).collect() == []
