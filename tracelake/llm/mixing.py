"""Mixing sources to target weights (9) by hash-threshold histograms.

Tokens are summed by source and bucket of a document hash; the bucket in which a source's running sum passes its budget is
split again by the next bits of the hash, and only that one, until a single hash value is left. A document is in if its
hash is under its source's threshold: a filter, no sort of documents. Budgets need only the totals of sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import broadcast_if_small, checkpoint, columns, fresh, read, row_key
from tracelake.llm.numbering import numbered

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Bits of the hash that a level of the histogram splits by; 60 bits in all.
BITS, DEPTH = 12, 60


def n_words(text):
    """Number of words: what is left between blanks."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: shares by weight, capped at ``most`` times the source.

    Each round gives what is left to the sources under their cap, by weight, and caps those that would pass it; a round
    is one sum over the sources, of which nothing but two figures comes to the driver.
    """
    # Null last; the number of a source, of which there may be many, without a sort in one task.
    ranked = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ranked = numbered(ranked.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = checkpoint(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rate = -1.0
    while True:
        over = F.col("weight") * F.lit(rate) >= F.col("cap") if rate >= 0 else F.lit(False)
        got = s.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not got[1]:
            break
        now = (min(share, most) * total - got[0]) / got[1]
        if now <= rate * (1 + 1e-15):
            break
        rate = now
    return s.select("source", "source_size", F.least(F.col("weight") * F.lit(max(rate, 0.0)), F.col("cap")).alias("target"))


def hashed(id_, text, source):
    """The DEPTH bits that decide on a row."""
    return F.shiftrightunsigned(row_key(id_, text, source)[0], 64 - DEPTH)


def plan(d: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, int]:
    """``s, source_size, target, base, threshold`` by source, and the number of sources, from ``source, size, h``."""
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, weights, share, most).withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    t = checkpoint(t.withColumn("left", F.col("target") - F.col("base") * F.col("source_size")))
    n_sources = t.count()
    # `low`: the first hash of the bucket on the border so far; `left`: the budget that remains for it.
    border = t.select("source", "left", F.lit(0).cast("long").alias("low"))
    own = d.where(F.col("size") > 0)
    for shift in range(DEPTH - BITS, -1, -BITS):
        near = broadcast_if_small(border.select(F.col("source").alias("s"), "left", "low"), n_sources)
        inside = own.join(near, own["source"].eqNullSafe(near["s"]))
        inside = inside.where(F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS))
        buckets = inside.groupBy("source", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        buckets = buckets.withColumn("sum", F.sum("words").over(upto)).where(F.col("sum") > F.col("left"))
        first = buckets.groupBy("source").agg(F.min(F.struct("bucket", (F.col("left") - F.col("sum") + F.col("words")).alias("rest"), "words")).alias("b"))
        border = checkpoint(first.select("source", F.col("b.rest").alias("left"), F.shiftleft("b.bucket", shift).alias("low"), F.col("b.words").alias("words")))
    # Of the hash at the border: in if more of it lies within the budget than beyond. Sources without a border take all.
    edge = border.select(F.col("source").alias("s"), (F.col("low") + F.when(F.col("left") * 2 >= F.col("words"), 1).otherwise(0)).alias("threshold"))
    threshold = F.when(F.col("left") <= 0, 0).otherwise(F.coalesce("threshold", F.lit((1 << DEPTH) + 1)))
    found = t.join(edge, t["source"].eqNullSafe(edge["s"]), "left").select(t["source"].alias("s"), "source_size", "target", "base", threshold.alias("threshold"))
    return checkpoint(found), n_sources


def times(most: float):
    """How often a row with ``h`` is taken under its source's plan."""
    return F.least(F.col("base") + (F.col("h") < F.col("threshold")).cast("int"), F.lit(int(most))).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, h, size, source_size, target, copies, taken``: every row, ``copies`` the times it is taken, ``taken`` its words.

    A source gets ``share`` of all words by its weight (weights repeat along sources by code point, null last), never more
    than ``most`` times its own. The whole part of target / size is taken from every document, the rest from those with a
    hash under the threshold, the one at it if that comes nearer to the target. The hash ``h`` is of id, text and source, so
    reruns agree and repeated rows are treated alike. Null and empty texts have size 0. An empty table gives an empty
    result; other columns are not read.
    """
    d = columns(docs, id=id_col, text=text_col, source=source_col)
    d = checkpoint(d.select("id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), hashed(d["id"], d["text"], d["source"]).alias("h")))
    of, n = plan(d.select("source", "size", "h"), weights, share, most)
    out = d.join(broadcast_if_small(of, n), d["source"].eqNullSafe(of["s"])).withColumn("copies", times(most))
    return out.select(F.col("id").alias("doc_id"), "h", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows and columns of ``docs``, each row as often as ``mix`` takes it: a filter by hash, without a shuffle of texts."""
    h, source, s, base, threshold = fresh(docs, "h", "source_", "s", "base", "threshold")
    id_, text, from_ = (docs[f"`{x}`"] for x in (id_col, text_col, source_col))
    d = checkpoint(docs.select(from_.cast("string").alias("source"), n_words(text).alias("size"), hashed(id_, text, from_).alias("h")))
    of, n = plan(d, weights, share, most)
    of = of.select(F.col("s").alias(s), F.col("base").alias(base), F.col("threshold").alias(threshold))
    rows = docs.select("*", hashed(id_, text, from_).alias(h), from_.cast("string").alias(source))
    rows = rows.join(broadcast_if_small(of, n), rows[source].eqNullSafe(of[s]))
    copies = F.least(F.col(base) + (F.col(h) < F.col(threshold)).cast("int"), F.lit(int(most))).cast("int")
    return rows.select(*[docs[f"`{x}`"] for x in docs.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias(s)).drop(s)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
