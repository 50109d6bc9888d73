"""Quantiles and rates against plain Python, over values with ties, nulls and a kind that has most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import metrics
from tracelake.sources import sinks


def test_quantiles(spark):
    rng = random.Random(4)
    rows = [("hot", float(rng.randrange(300))) for _ in range(4000)] + [(k, v) for k, n in (("one", 1), ("two", 2), (None, 7)) for v in [rng.random() for _ in range(n)]] + [("hot", None), ("none", None)] + [("same", 2.5)] * 50
    got = {r.kind: (r.p0, r.p50, r.p97_5, r.p100) for r in metrics.quantiles(spark.createDataFrame(rows, "kind string, v double"), "kind", "v", (0, 0.5, 0.975, 1)).collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert got == {k: pytest.approx(tuple(np.quantile(v, [0, 0.5, 0.975, 1])), abs=1e-6) for k, v in values.items()}
    assert metrics.quantiles(spark.createDataFrame([], "kind string, v double"), "kind", "v").collect() == []


def test_a_kind_of_most_rows_is_in_many_tasks(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(0).alias("kind"), F.rand(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = rows.groupBy("kind", "v").agg(F.count("*").alias("n")).repartitionByRange("kind", "v")
        sizes = [r["count"] for r in counted.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 100_000


@pytest.mark.parametrize("bounds", [(0.5, 1.0, 5.0), (-1.0, 2.0)])
def test_bucket_quantiles(spark, bounds):
    rng = random.Random(7)
    rows = [(f"k{i % 3}", i % 11, rng.choice([0.1, 0.4, 0.5, 0.7, 1.0, 3.0, 9.0, -2.0]) if i % 17 else None) for i in range(300)] + [("empty", 1, None)]
    df = spark.createDataFrame(rows, "kind string, machine int, v double")
    h = df.groupBy("kind", "machine").agg(sinks.buckets_of(F.col("v"), bounds).alias("b"))
    got = {r.kind: (r["count"], r.p10, r.p50, r.p99) for r in metrics.merged_quantiles(h, "kind", "b", bounds, (0.1, 0.5, 0.99)).collect()}

    def plain(values, q):
        if not values:
            return None
        rank, below = q * len(values), 0
        for i, b in enumerate(bounds):
            upto = sum(v <= b for v in values)
            if upto >= rank:
                if i == 0 and b <= 0:
                    return b
                low = bounds[i - 1] if i else 0.0
                return low + (b - low) * (rank - below) / (upto - below) if upto > below else low
            below = upto
        return bounds[-1]

    for k in ("k0", "k1", "k2", "empty"):
        values = [v for x, _, v in rows if x == k and v is not None]
        assert got[k] == (len(values), *[None if (p := plain(values, q)) is None else pytest.approx(p, abs=1e-6) for q in (0.1, 0.5, 0.99)])


def test_rates_of_counters(spark):
    rng = random.Random(9)
    rows = []
    for series in ("a", "b", None):
        v, t = 5, 100
        for _ in range(400):
            t += rng.choice([0, 1, 7, 60, 400])
            v = rng.randrange(20) if rng.random() < 0.05 else v + rng.randrange(9)
            rows.append((series, t, v))
    rows += [("a", None, 3), ("a", 120, None), ("single", 50, 9)]
    want = {}
    for series in ("a", "b", None, "single"):
        before = None
        for t, v in sorted((t, v) for s, t, v in rows if s == series and t is not None and v is not None):
            w = want.setdefault((series, t // 300 * 300), [0, 0, 0])
            w[0] += 1
            w[1] += before is not None and v < before
            w[2] += 0 if before is None else v - before if v >= before else v
            before = v
    rng.shuffle(rows)
    got = metrics.increases(spark.createDataFrame(rows, "series string, t long, v long"), "series", "t", "v", 300).collect()
    assert {(r.series, r.start): [r.samples, r.resets, r.increase] for r in got} == want and len(got) == len(want)
    assert all(r.rate == round(r.increase / 300, 6) for r in got)
