"""Each stage against plain Python on a small table with hard cases; the run as their composition."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline

from tests.llm import brute
from tests.llm.test_operators import DIR, docs, items, table  # noqa: F401
from tracelake.llm import mixing, near_dedup


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def shingles(text):
    w = (text or "").translate(brute.LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, table):  # noqa: F811
    names = [n for n, _ in corpus_pipeline.STAGES]
    language, dedup, free, mix, shards = (f for _, f in corpus_pipeline.STAGES)
    assert len(names) == 5 and names[0] == "language_id"
    one = language(spark, table, DIR).cache()
    assert one.columns == table.columns
    gone = Counter(map(tuple, table.collect())) - Counter(map(tuple, one.collect()))
    assert gone and all(len(set((r[1] or "").split())) < 3 for r in gone)
    assert sum(gone.values()) + one.count() == table.count()

    two = dedup(spark, one, DIR).cache()
    assert two.columns == table.columns
    left = Counter(map(tuple, one.collect()))
    stay = Counter(map(tuple, two.collect()))
    assert not stay - left and max(stay.values()) == 1
    sets = {r: shingles(r[1]) for r in left}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    kept_rows = list(stay)
    assert all(alike(a, b) < 0.8 for i, a in enumerate(kept_rows) for b in kept_rows[:i])
    assert all(any(alike(r, x) >= 0.8 for x in left if x != r) for r in left if r not in stay and left[r] == 1)
    kept = [r.doc_id for r in two.collect()]

    three = free(spark, two, DIR).cache()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    bad = {d for d, _, _, _, _, hit in brute.decontaminate([(r.doc_id, r.text) for r in two.collect()], bench) if hit}
    assert bad and sorted((r.doc_id for r in three.collect()), key=repr) == sorted((x for x in kept if x not in bad), key=repr)

    four = mix(spark, three, DIR).cache()
    want = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    have = Counter(r.doc_id for r in four.collect())
    assert four.columns == table.columns and {d: have.get(d, 0) for d in want} == want and set(want.values()) >= {1, 2}

    five = shards(spark, four, DIR)
    assert Counter(r.doc_id for r in five.collect()) == have


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 100 and {"doc_id", "shard", "slot"} <= set(out.columns)
    assert rows(out.select("doc_id", "shard")) == rows(corpus_pipeline.run(spark, DIR).select("doc_id", "shard"))


def test_stages_of_an_empty_table(spark, table):  # noqa: F811
    docs_ = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, DIR)
        assert docs_.count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_by_fingerprints(spark, monkeypatch):
    """With prefixes switched off, fingerprints still find what is near by them; an exact check drops pairs whose fingerprints are equal but not their texts."""
    body = " ".join(f"w{i % 11}" for i in range(1100))
    far = [f"{body} " + " ".join(f"{own}{i}" for i in range(40)) for own in "xy"]
    near = [(own := " ".join(f"v{i % 31}" for i in range(1000))), f"{own} end"]
    texts = [*far, *near, *near[:1], "another text that has nothing in common with them"]
    fps, sets = [near_dedup.shingle_fingerprint(t.encode()) for t in texts], [shingles(t) for t in texts]
    assert all((fps[i] ^ fps[i + 1]).bit_count() <= 3 for i in (0, 2))
    assert [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in (0, 2)] == [False, True]

    def none(batches):
        for batch in batches:
            if batch.num_rows < 0:
                yield batch

    monkeypatch.setattr(near_dedup, "first_pairs", none)
    docs_ = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_, DIR).orderBy("doc_id").collect()] == [0, 1, 2, 5]
