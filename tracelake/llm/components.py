"""Connected components without a driver-side graph: alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import checkpoint

#: Edges of a partition, at least, that is kept after a step: few edges don't make a file for each shuffle partition.
ROWS = 100_000


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (its smallest node) for every node of an edge, from integer columns ``a, b``.

    Self-loops, repeated edges and null ends are allowed and change nothing. Steps end when a round leaves the edges as they
    were, after about the logarithm of the longest path. Least neighbours are partial sums kept reliably before they are
    joined, so that both sides of each join are plain exchanges, which adaptive execution splits at a hub.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = checkpoint(e)
    was = _marks(e)
    kept = lambda df: checkpoint(df.coalesce(max(1, -(-was[0] // ROWS))))
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = kept(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _marks(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
