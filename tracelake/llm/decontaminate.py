"""Benchmark decontamination (3) by winnowing: the minimum 5-gram hash of each sliding window, joined and extended.

Only DataFrame functions. Of each 10-word window, which has six 5-grams, both sides keep the leftmost minimum, so that any
shared 10-word span shares a fingerprint. Document fingerprints meet those of the benchmark in a broadcast join while their
counted number is within a bound, else in a shuffled one. A hit is then extended: the windows around it are compared with
the benchmark's windows by 128 hash bits. Items of under 10 words, too short for that guarantee, are looked up whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.llm.common import broadcast_if_small, checkpoint, columns, lower_ascii, read, row_key

WINDOW, GRAM = 10, 5
#: What is between words; A-Z are lower-cased, not separators.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN, -1), "")


def ngram_hash(words: Column, start: Column, n: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.get(words, start + j) for j in range(n)])


def upto(last: Column) -> Column:
    """0 to ``last``, or no index if it is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def lowered(text: Column) -> Column:
    """``lower_ascii``; where all is ASCII, as ``lower`` does it, which is many times faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))


def sliding(d: DataFrame, col: str, n: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """``col``, an array, becomes the array of ``f`` of all of each n elements in a row, by doubling; the last n - 1 are of fewer.

    Each step is a projection of its own, so that an element of it is worked out once; ``f`` leaves out nulls.
    """
    reach = 1
    while reach < n:
        ahead = min(reach, n - reach)
        x = F.col(col)
        d = d.withColumn(col, F.zip_with(x, F.slice(x, F.lit(1 + ahead), F.size(x)), f))
        reach += ahead
    return d


def fingerprints(d: DataFrame, keep: list[str], window: int, gram: int) -> DataFrame:
    """``keep`` and ``fp`` (31 bits), ``pos``: one row for each distinct fingerprint of ``words``, the least gram of each window.

    A word is hashed once, and a gram's hash is that of hashes. With its position below, the leftmost of equal ones is the least.
    """
    whole = lambda n: F.slice("v", F.lit(1), F.greatest(F.col("n") - (n - 1), F.lit(0)))
    d = d.select(*keep, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("v"))
    d = sliding(d, "v", gram, lambda x, y: F.xxhash64(x, y)).select(*keep, "n", whole(gram).alias("v"))
    d = d.withColumn("v", F.transform("v", lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(i.cast("long"))))
    d = sliding(d, "v", window - gram + 1, lambda x, y: F.least(x, y)).select(*keep, F.explode(F.array_distinct(whole(window))).alias("v"))
    return d.select(*keep, F.shiftright("v", 32).alias("fp"), F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, k1, k2, n_words, n_hit, items``: every document row; items is the sorted array of item ids, as strings.

    Null, empty or wordless texts have no words, match nothing and are matched by nothing. Repeated documents are all
    returned, alike. Items of equal words are all named; null item ids are left out of the names (their windows still hit).
    Empty tables give no rows, or rows without hits. Other columns are not read.
    """
    d = columns(docs, id=id_col, text=text_col)
    d = d.select("id", "text", *row_key(d["id"], d["text"]))
    # Nulls are left out by text, so that no filter splits texts a second time.
    texts = d.where(F.col("text").isNotNull()).select("k1", "k2", "text")
    words = words_of(lowered(F.col("text"))).alias("words")
    worded = texts.select("k1", "k2", words)

    b = columns(items, item=item_id, text=item_text).select(F.col("item").cast("string").alias("item"), words_of(lowered(F.col("text"))).alias("words"))
    b = checkpoint(b.where(F.size("words") > 0).select("item", "words", F.least(F.size("words"), F.lit(window)).alias("n"), F.xxhash64("words").alias("c1"), F.xxhash64(F.lit(1), "words").alias("c2")))
    lengths = sorted(r["n"] for r in b.select("n").distinct().collect())  # at most `window` of them
    unique = b.dropDuplicates(["c1", "c2"])
    spans = None
    for n in lengths:
        starts = F.explode(upto(F.size("words") - n))
        one = unique.where(F.col("n") == n).select("c1", "c2", "words", starts.alias("i")).select("c1", "c2", F.lit(n).alias("n"), *[ngram_hash(F.col("words"), F.col("i"), n, s).alias(f"w{s}") for s in (1, 2)])
        spans = one if spans is None else spans.unionByName(one)
    if spans is None:
        return d.select(F.col("id").alias("doc_id"), "k1", "k2", F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    spans = checkpoint(spans.distinct())

    n_spans = spans.count()
    # Only whether a window is one of the benchmark's: no row for each item that has it.
    windows = checkpoint(spans.select("n", "w1", "w2").distinct())
    found = []
    if window in lengths:
        theirs = checkpoint(fingerprints(unique.where(F.col("n") == window), [], window, gram).select("fp").distinct())
        hits = fingerprints(worded, ["k1", "k2"], window, gram).join(broadcast_if_small(theirs, theirs.count()), "fp", "left_semi")
        hits = checkpoint(hits.groupBy("k1", "k2").agg(F.collect_set("pos").alias("pos")))
        size = hits.agg(F.sum(F.size("pos") + 8)).first()[0] or 0
        # Only texts that are hit are split again.
        hit = texts.join(broadcast_if_small(hits, size, 10 * common.BROADCAST_ROWS), ["k1", "k2"]).select("k1", "k2", "pos", words)
        around = F.array_distinct(F.flatten(F.transform("pos", lambda p: F.sequence(F.greatest(p - (window - gram), F.lit(0)), p))))
        at = hit.select("k1", "k2", "words", F.explode(around).alias("i")).where(F.col("i") <= F.size("words") - window)
        found.append(at.select("k1", "k2", "i", F.lit(window).alias("n"), *[ngram_hash(F.col("words"), F.col("i"), window, s).alias(f"w{s}") for s in (1, 2)]))
    # A pass for each shorter length that there is: rows that keep the words while they wait for a second explode would not fit.
    for n in (n for n in lengths if n < window):
        at = worded.select("k1", "k2", "words", F.explode(upto(F.size("words") - n)).alias("i"))
        found.append(at.select("k1", "k2", "i", F.lit(n).alias("n"), *[ngram_hash(F.col("words"), F.col("i"), n, s).alias(f"w{s}") for s in (1, 2)]))
    matched = None
    for at in found:
        one = at.join(broadcast_if_small(windows, n_spans), ["n", "w1", "w2"], "left_semi")
        matched = one if matched is None else matched.unionByName(one)
    matched = checkpoint(matched)

    cover = F.aggregate(
        F.array_sort(F.collect_set(F.struct("i", "n"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["i"] + x["n"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["i"] + x["n"] - F.greatest(a["end"], x["i"]))).alias("n")),
        lambda a: a["n"],
    )
    covered = matched.groupBy("k1", "k2").agg(cover.alias("n_hit"))
    named = checkpoint(b.where(F.col("item").isNotNull()).groupBy("c1", "c2").agg(F.collect_set("item").alias("ids")))
    classes = checkpoint(matched.select("k1", "k2", "w1", "w2", "n").distinct())
    classes = checkpoint(classes.join(broadcast_if_small(spans, n_spans), ["w1", "w2", "n"]).select("k1", "k2", "c1", "c2").distinct())
    ids = classes.join(broadcast_if_small(named, named.count()), ["c1", "c2"]).groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    out = d.select("id", "k1", "k2", F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long").alias("n_words")).join(covered, ["k1", "k2"], "left").join(ids, ["k1", "k2"], "left")
    return out.select(F.col("id").alias("doc_id"), "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS span
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS span FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.span = bw.span),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
