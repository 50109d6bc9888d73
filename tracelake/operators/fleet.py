"""Several instances: heartbeats, time-out estimates, gathered searches, agreement of ensembles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, BETA, K, FLOOR, COLD = 0.25, 0.25, 4.0, 0.05, 3.0


def estimate(rtts: Column) -> Column:
    """The time-out (seconds) after the ordered round-trip times of an array: smoothed mean and four deviations.

    The first sample sets the mean and half of it as deviation; then the deviation follows first, from the old mean. A null stands
    for a time-out: it doubles the mean. Without samples it is three seconds; it never is less than 50 ms.
    """
    kind = "struct<srtt:double,var:double,n:int>"
    start = F.struct(F.lit(0.0).alias("srtt"), F.lit(0.0).alias("var"), F.lit(0).alias("n")).cast(kind)
    step = lambda a, r: F.when(r.isNull(), F.struct((a["srtt"] * 2).alias("srtt"), a["var"].alias("var"), a["n"].alias("n"))).when(a["n"] == 0, F.struct(r.alias("srtt"), (r / 2).alias("var"), F.lit(1).alias("n"))).otherwise(
        F.struct((a["srtt"] * (1 - ALPHA) + r * ALPHA).alias("srtt"), (a["var"] * (1 - BETA) + F.abs(a["srtt"] - r) * BETA).alias("var"), (a["n"] + 1).alias("n")))
    return F.aggregate(rtts, start, step, lambda a: F.when(a["n"] == 0, COLD).otherwise(F.greatest(a["srtt"] + a["var"] * K, F.lit(FLOOR))))


def heartbeat_rounds(pongs: DataFrame, own: str) -> DataFrame:
    """Of each round (``round, instance, rtt``) the slowest answer of another instance; rounds without any are left out."""
    return pongs.where(F.col("instance") != own).groupBy("round").agg(F.max("rtt").alias("rtt"), F.countDistinct("instance").alias("responders"))


def timeouts(rounds: DataFrame, by: str) -> DataFrame:
    """The estimate (see ``estimate``) for each ``by`` after its rounds in order.

    Rounds are sorted within tasks and folded as they pass, so that one with any number of rounds takes no memory.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, have, n, srtt, var, samples = None, False, 0, 0.0, 0.0, 0

        def done() -> list:
            return [(key, n, round(COLD if not samples else max(srtt + K * var, FLOOR), 6))]

        for frame in frames:
            out = []
            for k, r in zip(frame["by"], frame["rtt"]):
                k = None if pd.isna(k) else k
                if not have or k != key:
                    out += done() if have else []
                    key, have, n, srtt, var, samples = k, True, 0, 0.0, 0.0, 0
                n += 1
                if pd.isna(r):
                    srtt *= 2
                elif not samples:
                    srtt, var, samples = r, r / 2, 1
                else:
                    srtt, var, samples = srtt * (1 - ALPHA) + r * ALPHA, var * (1 - BETA) + abs(srtt - r) * BETA, samples + 1
            yield pd.DataFrame(out, columns=["by", "rounds", "rto"])
        yield pd.DataFrame(done() if have else [], columns=["by", "rounds", "rto"])

    r = rounds.select(F.col(by).alias("by"), "round", F.col("rtt").cast("double").alias("rtt"))
    r = r.repartition("by").sortWithinPartitions("by", "round", "rtt").drop("round")
    return r.mapInPandas(fold, f"by {r.schema['by'].dataType.simpleString()}, rounds long, rto double").withColumnRenamed("by", by)


def gather(results: DataFrame, own: str | None, limit: int, score: str = "rank") -> DataFrame:
    """The best ``limit`` rows of each other instance."""
    r = results if own is None else results.where(F.col("instance") != own)
    w = Window.partitionBy("instance").orderBy(score, "id")
    return r.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def answer(results: DataFrame, respond: bool, limit: int, score: str = "rank") -> DataFrame:
    """What an instance answers to another's search: its best ``limit`` rows, none if it doesn't respond."""
    return results.orderBy(score, "id").limit(limit if respond else 0)


def _choose(n: Column, k: Column) -> Column:
    """How many ways there are to take ``k`` of ``n``."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: F.when(i <= k, a * (n - k + i) / i).otherwise(a))


def _majority_right(p: Column, n: Column) -> Column:
    """The chance that at least half of ``n`` (int) are right if each is with chance ``p``."""
    terms = F.transform(F.sequence(F.ceil(n / 2).cast("int"), n), lambda k: _choose(n, k) * F.pow(p, k) * F.pow(1 - p, n - k))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _agreement() -> Column:
    return F.avg(F.greatest("k", F.col("n") - F.col("k")) / F.col("n"))


def ensemble_quality(votes: DataFrame) -> DataFrame:
    """From ``claim, n, k`` (k of n agree): mean agreement, and the chance that a majority of n is right, by n."""
    p = votes.groupBy("n").agg(F.count("*").alias("claims"), _agreement().alias("p"))
    return p.select("n", "claims", F.round("p", 6).alias("agreement"), F.round(_majority_right(F.col("p"), F.col("n").cast("int")), 6).alias("majority_right"))


def document_quality(claims: DataFrame) -> DataFrame:
    """Of each document that n wrote together, by its claims (``document, n, k, tagged, wrong``; k of the n make the claim, ``tagged``
    if they call it verified, ``wrong`` if a check found it so; nulls: no): mean agreement; the chance that a majority is right; the
    calibration, that is the share of tagged claims that aren't wrong (1 without any); and the product of both.

    Claims without n or k, or with n below 1, tell nothing of agreement but count for the calibration. A document is judged by
    each n that it has; n is null where only such claims are left.
    """
    n = F.when((F.col("n") >= 1) & F.col("k").isNotNull(), F.col("n"))
    c = claims.select("document", n.cast("int").alias("n"), "k", F.coalesce("tagged", F.lit(False)).alias("tagged"), F.coalesce("wrong", F.lit(False)).alias("wrong"))
    d = c.groupBy("document", "n").agg(F.count("*").alias("claims"), _agreement().alias("p"), F.count_if("tagged").alias("tagged"), F.count_if(F.col("tagged") & F.col("wrong")).alias("failed"))
    right = F.when(F.col("n").isNotNull(), _majority_right(F.col("p"), F.col("n")))
    calibration = F.when(F.col("tagged") > 0, 1 - F.col("failed") / F.col("tagged")).otherwise(1.0)
    return d.select("document", "n", "claims", "tagged", "failed", F.round("p", 6).alias("agreement"), F.round(right, 6).alias("majority_right"), F.round(calibration, 6).alias("calibration"), F.round(right * calibration, 6).alias("quality"))


def agreement_tiers(claims: DataFrame) -> DataFrame:
    """How many claims of a document have each agreement (``document, n, k, claims, expected``), next to how many there would be
    if each of the n were right with the document's mean agreement, independently. Impossible votes are left out."""
    v = claims.where("n >= 1 AND k BETWEEN 0 AND n").select("document", F.col("n").cast("int").alias("n"), F.col("k").cast("int").alias("k"))
    tiers = v.groupBy("document", "n", "k").agg(F.count("*").alias("claims"))
    p = tiers.groupBy("document", "n").agg(F.sum("claims").alias("all"), (F.sum(F.greatest("k", F.col("n") - F.col("k")) * F.col("claims")) / F.sum(F.col("n") * F.col("claims"))).alias("p"))
    n, k = F.col("n"), F.col("k")
    return tiers.join(p, ["document", "n"]).select("document", "n", "k", "claims", F.round(F.col("all") * _choose(n, k) * F.pow("p", k) * F.pow(1 - F.col("p"), n - k), 4).alias("expected"))
