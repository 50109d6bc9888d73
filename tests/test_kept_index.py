"""The kept index against one built anew, after additions, removals, merges and failures; searches tokenise once."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators import kept_index, search

TEXTS = ["the quick brown fox", "quick brown dogs and the fox", "a fox is quick", "brown bread", "", "running foxes run; the runner ran", "quick quick quick", "brown quick", None, "Ünïcode fox", "the the the"]
QUERIES = ("quick brown NOT fox", '"quick brown" OR run*', "the OR missing")


def table(spark, ids, text=lambda i: TEXTS[i] if i < len(TEXTS) else "x"):
    return spark.createDataFrame([(i, text(i)) for i in ids], "doc long, x string")


def same(spark, path, corpus, stemmed):
    index, fresh = kept_index.load(spark, path), search.build(corpus, "doc", "x", stemmed)
    assert index.n == corpus.count()
    for query in QUERIES:
        have, want = ({r["doc"]: round(r["rank"], 6) for r in search.matches(x, query).collect()} for x in (index, fresh))
        assert have == want, query
    assert search.missing_postings(index, corpus, "doc", "x").count() == 0


@pytest.mark.parametrize("stemmed,buckets", [(True, 5)])
def test_kept_index(spark, tmp_path, stemmed, buckets):
    path = str(tmp_path)
    kept_index.create(spark, path, stemmed, buckets)
    assert search.matches(kept_index.load(spark, path), "quick").collect() == []
    assert kept_index.add(spark, path, table(spark, range(4)), "doc", "x") == 4
    # Only new documents are taken, and a null id is none.
    assert kept_index.add(spark, path, table(spark, range(11)).unionByName(spark.createDataFrame([(None, "fox")], "doc long, x string")), "doc", "x") == 7
    assert kept_index.add(spark, path, table(spark, range(11)), "doc", "x") == 0
    same(spark, path, table(spark, range(11)), stemmed)
    assert kept_index.remove(spark, path, table(spark, [1, 2, 2, 77])) == 2 and kept_index.remove(spark, path, table(spark, [1])) == 0
    left = [0, *range(3, 11)]
    same(spark, path, table(spark, left), stemmed)
    # A document may come back with another text.
    other = lambda i: "quick bread and bread"
    assert kept_index.add(spark, path, table(spark, [2], other), "doc", "x") == 1
    now = table(spark, left).unionByName(table(spark, [2], other))
    same(spark, path, now, stemmed)
    before = kept_index.state(spark, path)
    assert len(before.segments) == 3 and before.removed
    after = kept_index.merge(spark, path)
    assert len(after.segments) < 3
    same(spark, path, now, stemmed)
    assert len(kept_index.rebuild(spark, path).segments) == 1 and not kept_index.state(spark, path).removed
    same(spark, path, now, stemmed)
    assert kept_index.vacuum(spark, path) >= 3 and kept_index.vacuum(spark, path) == 0
    same(spark, path, now, stemmed)


def test_rewrite_after_a_large_purge(spark, tmp_path):
    path = str(tmp_path)
    kept_index.create(spark, path, False, 4)
    kept_index.add(spark, path, table(spark, range(11)), "doc", "x")
    kept_index.remove(spark, path, table(spark, [0, 1]))
    assert kept_index.state(spark, path).removed
    kept_index.remove(spark, path, table(spark, [3, 4, 5]))
    assert not kept_index.state(spark, path).removed
    same(spark, path, table(spark, [2, 6, 7, 8, 9, 10]), False)
    kept_index.remove(spark, path, table(spark, range(11)))
    assert kept_index.state(spark, path).n == 0 and search.matches(kept_index.load(spark, path), "quick").collect() == []


def test_a_change_that_fails_leaves_what_was_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    kept_index.create(spark, path, False, 4)
    kept_index.add(spark, path, table(spark, range(5)), "doc", "x")

    def lost(*_):
        raise OSError("lost")

    for change in (lambda: kept_index.add(spark, path, table(spark, [5, 6]), "doc", "x"), lambda: kept_index.remove(spark, path, table(spark, [0])), lambda: kept_index.rebuild(spark, path)):
        with monkeypatch.context() as m:
            m.setattr(kept_index, "_commit", lost)
            with pytest.raises(OSError):
                change()
        same(spark, path, table(spark, range(5)), False)
    assert kept_index.add(spark, path, table(spark, range(7)), "doc", "x") == 2
    same(spark, path, table(spark, range(7)), False)


def test_removed_documents_may_be_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept_index, "BROADCAST", 0)
    kept_index.create(spark, str(tmp_path), False, 4)
    kept_index.add(spark, str(tmp_path), table(spark, range(11)), "doc", "x")
    kept_index.remove(spark, str(tmp_path), table(spark, [1]), rewrite=2)
    same(spark, str(tmp_path), table(spark, [0, *range(2, 11)]), False)


@pytest.mark.parametrize("buckets", [3, 70])
def test_stored_index_with_other_buckets(spark, tmp_path, buckets):
    index = search.build(table(spark, range(11)), "doc", "x", False)
    own = search.store(index, str(tmp_path / "i"), buckets)
    for query in QUERIES:
        assert {r.doc: round(r.rank, 6) for r in search.matches(own, query).collect()} == {r.doc: round(r.rank, 6) for r in search.matches(index, query).collect()}


@pytest.mark.parametrize("query", ["quick", "quick AND brown", '"quick brown fox"', '"quick brown" OR bre* NOT fox'])
def test_texts_are_tokenised_once(spark, query):
    df = search.matches(search.build(table(spark, range(11)), "doc", "x", False), query)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_phrases_in_long_texts(spark):
    """A phrase costs time in proportion to a text: quadratic, this one of 400,000 words would take hours."""
    texts = spark.range(2).select(F.col("id").alias("doc"), F.repeat(F.lit("quick brown "), 200_000).alias("x"))
    assert [r.doc for r in search.matches(search.build(texts, "doc", "x", False), '"brown quick"').orderBy("doc").collect()] == [0, 1]


def test_postings_are_grouped_where_texts_are(spark, monkeypatch):
    """Postings of many texts at once against plain grouping, in pieces of few tokens; grouping them shuffles nothing."""
    monkeypatch.setattr(search, "TOKENS", 7)
    texts = [(1, ["a", "b", "a"]), (2, []), (3, ["b"]), (4, ["c", "a", "c", "c", "d", "e", "f", "a", "é"]), (5, ["a"])]
    df = spark.createDataFrame(texts, "doc bigint, tokens array<string>")
    for present in (None, ""):
        want = {(t, d, tuple(i for i, x in enumerate(w) if x == t), len(w)) for d, w in texts for t in w} | ({("", d, (len(w),), len(w)) for d, w in texts} if present == "" else set())
        made = search.postings_of(df, present)
        have = [(r.term, r.doc, tuple(r.positions), r.dl) for r in made.collect()]
        assert sorted(have) == sorted(want) and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_integrity_gathers_what_differs_only(spark, tmp_path):
    """A document that is gone, one with a word more, one of the same words in another order and one too many, in an index as stored and as made on the fly."""
    rows = [(1, "a b a"), (2, "b c"), (3, "c d e"), (4, "x y"), (5, ""), (6, "same words here")]
    other = [(1, "a b a"), (2, "b c c"), (3, "d c e"), (5, ""), (6, "same words here"), (7, "new")]
    corpus, wrong = (spark.createDataFrame(x, "id long, x string") for x in (rows, other))
    index = search.build(wrong, "id", "x", stemmed=False)
    want = {("missing", 2, "c", "1"), ("extra", 2, "c", "1,2"), ("missing", 3, "c", "0"), ("missing", 3, "d", "1"), ("extra", 3, "d", "0"), ("extra", 3, "c", "1"), ("missing", 4, "x", "0"), ("missing", 4, "y", "1"), ("extra", 7, "new", "0")}
    for own in (index, search.store(index, str(tmp_path / "index"), 4)):
        found = search.missing_postings(own, corpus, "id", "x")
        # A text's length is a part of its digest only: the word that is as before doesn't count.
        assert {(r.side, r.doc, r.term, r["at"]) for r in found.collect()} == want
    gathered = []
    plain = search._of_docs
    search._of_docs = lambda i, docs: gathered.append(sorted(r.doc for r in docs.collect())) or plain(i, docs)
    try:
        search.missing_postings(index, corpus, "id", "x").collect()
    finally:
        search._of_docs = plain
    assert gathered[0] == [2, 3, 4, 7]
