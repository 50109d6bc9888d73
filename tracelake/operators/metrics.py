"""Figures over time: quantiles of values and of histograms' buckets, and rates of counters that start anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.reliable import checkpoint

QUANTILES = (0.5, 0.95, 0.99)


def names(at: Sequence[float]) -> list[str]:
    """p50, p95, p99 and so on; a fraction of a hundredth is set off by an underscore."""
    return ["p" + f"{q * 100:.6g}".replace(".", "_") for q in at]


def quantiles(rows: DataFrame, kind: str, value: str, at: Sequence[float] = QUANTILES) -> DataFrame:
    """``kind, p50, p95, ...``: exact quantiles of each kind, between two values in proportion; null values don't count.

    Equal values are counted first, then dealt out in order, so that a kind of a third of all rows is in many tasks. Sums by
    task tell which of them have the wanted ranks, and only their values are gathered. A null kind is a kind.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(kind).alias("kind"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    counted = checkpoint(counted.repartitionByRange("kind", "value")).withColumn("part", F.spark_partition_id())
    parts = counted.groupBy("kind", "part").agg(F.sum("n").alias("m"))
    of_kind = Window.partitionBy("kind")
    before = F.coalesce(F.sum("m").over(of_kind.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("kind").alias("_kind"), F.col("part").alias("_part"), before.alias("before"), F.sum("m").over(of_kind).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("kind", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).join(parts, F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("part") == F.col("_part")))
    upto, n, place = F.col("before") + F.col("upto"), F.col("n"), lambda q: F.lit(float(q)) * (F.col("total") - 1)
    has = lambda rank: (upto - n <= rank) & (rank < upto)
    ends = [F.max(F.when(has(f(place(q))), F.col("value"))).alias(f"{end}{i}") for i, q in enumerate(at) for end, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked.groupBy("kind").agg(F.max("total").alias("total"), *ends)
    out = [F.round(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place(q) - F.floor(place(q))), 6).alias(name) for i, (q, name) in enumerate(zip(at, names(at)))]
    return found.select(F.col("kind").alias(kind), *out)


def bucket_quantile(buckets: Column, bounds: Sequence[float], q: float) -> Column:
    """A quantile from cumulative counts by upper bound (``bounds``, then all): between a bucket's bounds in proportion, the first
    from 0 if its bound is positive; beyond the last bound that bound; null without any count."""
    limits = F.array(*[F.lit(float(b)) for b in bounds])
    rank = F.element_at(buckets, -1) * F.lit(float(q))
    i = F.size(F.filter(F.slice(buckets, 1, len(bounds)), lambda n: n < rank))  # buckets below the one that has the rank
    low = F.when(i == 0, F.least(F.lit(0.0), F.lit(float(bounds[0])))).otherwise(F.get(limits, i - 1))
    below = F.when(i == 0, F.lit(0)).otherwise(F.get(buckets, i - 1))
    inside = F.get(buckets, i) - below
    value = F.when(inside > 0, low + (F.get(limits, i) - low) * (rank - below) / inside).otherwise(low)
    # A negative first bound has nothing below it to go between.
    value = F.when((i == 0) & (F.lit(float(bounds[0])) <= 0), F.lit(float(bounds[0]))).otherwise(value)
    return F.when(F.element_at(buckets, -1) > 0, F.when(i >= len(bounds), F.lit(float(bounds[-1]))).otherwise(value))


def merged_quantiles(histograms: DataFrame, by: str, buckets: str, bounds: Sequence[float], at: Sequence[float] = QUANTILES) -> DataFrame:
    """``by, count, p50, ...`` of histograms over the same bounds, added up: they come from any number of tasks, days or machines."""
    sums = F.array(*[F.sum(F.get(buckets, F.lit(i))) for i in range(len(bounds) + 1)])
    merged = histograms.groupBy(by).agg(sums.alias("_b"))
    return merged.select(by, F.element_at("_b", -1).alias("count"), *[F.round(bucket_quantile(F.col("_b"), bounds, q), 6).alias(n) for q, n in zip(at, names(at))])


def increases(samples: DataFrame, series: str, time: str, value: str, width: int) -> DataFrame:
    """``series, start, samples, resets, increase, rate`` of a counter for each window of ``width`` seconds that has samples.

    A value below the one before it means that the counter has started anew, from 0. A window also has what was added since
    the last sample before it; a series' first sample adds nothing. Samples of one time are in order of value; those without
    a value or time don't count. Samples are compared within windows first, so a series of a third of all rows is in many
    tasks; what is between windows follows from one row for each.
    """
    s = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    s = s.select(F.col(series).alias("series"), (F.floor(F.col(time) / width) * width).cast("long").alias("start"), F.col(time).alias("t"), F.col(value).alias("v"))
    before = F.lag("v").over(Window.partitionBy("series", "start").orderBy("t", "v"))
    s = s.withColumn("before", before)
    added = lambda now, old: F.when(old.isNull(), 0).when(now >= old, now - old).otherwise(now)
    w = s.groupBy("series", "start").agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("v") < F.col("before")).alias("resets"),
        F.sum(added(F.col("v"), F.col("before"))).alias("inside"),
        F.min(F.struct("t", "v"))["v"].alias("first"),
        F.max(F.struct("t", "v"))["v"].alias("last"),
    )
    last = F.lag("last").over(Window.partitionBy("series").orderBy("start"))
    w = w.withColumn("last", last)
    total = F.col("inside") + added(F.col("first"), F.col("last"))
    resets = F.col("resets") + F.coalesce((F.col("first") < F.col("last")).cast("long"), F.lit(0))
    return w.select(F.col("series").alias(series), "start", "samples", resets.alias("resets"), total.alias("increase"), F.round(total / width, 6).alias("rate"))
