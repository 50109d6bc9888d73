"""Stance of sessions: quadrants, trend, exponential averages of phase and scope, shifts, and what they advise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.model import Tables

ALPHA = 0.08
QUADRANTS = ("think_diverge", "think_converge", "act_diverge", "act_converge")


def labelled(t: Tables) -> DataFrame:
    o = t.observations.where(F.col("phase").isNotNull() & F.col("scope").isNotNull())
    return o.select("session_id", "timestamp", "id", F.when(F.col("phase") == "act", 1).otherwise(-1).alias("p"), F.when(F.col("scope") == "converge", 1).otherwise(-1).alias("s"))


def quadrants(t: Tables) -> DataFrame:
    """Counts of the four combinations of phase and scope, and percentages to a tenth, by session."""
    counts = [F.count_if((F.col("p") == p) & (F.col("s") == s)).alias(f"n_{name}") for name, p, s in zip(QUADRANTS, (-1, -1, 1, 1), (-1, 1, -1, 1))]
    g = labelled(t).groupBy("session_id").agg(F.count("*").alias("total"), *counts)
    return g.select("*", *[(F.round(F.col(f"n_{q}") / F.col("total") * 1000) / 10).alias(f"pct_{q}") for q in QUADRANTS])


def dimensions(t: Tables) -> DataFrame:
    """Counts of locus, novelty and friction, their crossing, and shares in thousandths, by session, in one pass."""
    c = lambda column, value: F.count_if(F.col(column) == value)
    pairs = {"internal": "locus", "external": "locus", "routine": "novelty", "novel": "novelty", "smooth": "friction", "friction": "friction"}
    cross = [F.count_if((F.col("novelty") == n) & (F.col("friction") == f)).alias(f"{n}_{f}") for n in ("routine", "novel") for f in ("smooth", "friction")]
    g = t.observations.groupBy("session_id").agg(*[c(of, v).alias(f"n_{v}") for v, of in pairs.items()], *cross)
    share = lambda a, b: F.when(F.col(f"n_{a}") > 0, F.round(F.col(f"n_{a}") / (F.col(f"n_{a}") + F.col(f"n_{b}")) * 1000).cast("long")).alias(f"permille_{a}")
    return g.select("*", share("internal", "external"), share("novel", "routine"), share("friction", "smooth"))


def _average(points: Column, alpha: float, scan: int) -> tuple[Column, Column]:
    """The running averages (p, s, t) of the last ``scan`` points and the one before them, and that one's index from 0.

    What comes earlier is folded into one state, so that the array that grows in the fold is a short one.
    """
    m = F.greatest(F.size(points) - scan, F.lit(1))
    start = _last(F.slice(points, 1, m), alpha)
    first = F.array(F.struct(start["p"].alias("p"), start["s"].alias("s"), F.element_at(points, m)["timestamp"].alias("t")))
    step = lambda a, x: F.concat(a, F.array(F.struct((x["p"] * alpha + F.element_at(a, -1)["p"] * (1 - alpha)).alias("p"), (x["s"] * alpha + F.element_at(a, -1)["s"] * (1 - alpha)).alias("s"), x["timestamp"].alias("t"))))
    return F.aggregate(F.slice(points, m + 1, F.lit(scan)), first, step), m - 1


def _last(points: Column, alpha: float) -> Column:
    first = F.element_at(points, 1)
    step = lambda a, x: F.struct((x["p"] * alpha + a["p"] * (1 - alpha)).alias("p"), (x["s"] * alpha + a["s"] * (1 - alpha)).alias("s"))
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), F.struct(first["p"].cast("double").alias("p"), first["s"].cast("double").alias("s")), step)


def _points(t: Tables) -> DataFrame:
    """A session's points in order; a session has to fit a task, as it does in any ordered fold."""
    return labelled(t).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "p", "s"))).alias("points"))


def name(p: Column, s: Column) -> Column:
    return F.concat(F.when(p >= 0, "act").otherwise("think"), F.lit("+"), F.when(s >= 0, "converge").otherwise("diverge"))


def _direction(short: Column, long: Column, up: str, down: str) -> Column:
    return F.when(F.abs(short - long) < 0.2, "stable").when(short > long, f"shifting_{up}").otherwise(f"shifting_{down}")


def current(t: Tables, *, alpha: float = ALPHA) -> DataFrame:
    """Each session's averages, means of its last 5 and 20 points, their directions, and advice by the first rule that holds."""
    alpha = min(1.0, max(0.01, alpha))
    mean = lambda f, n: F.aggregate(F.slice("points", F.greatest(F.size("points") - n + 1, F.lit(1)), n), F.lit(0).cast("long"), lambda a, x: a + x[f]) / F.least(F.size("points"), F.lit(n))
    d = _points(t).select("session_id", F.size("points").cast("long").alias("n"), _last(F.col("points"), alpha).alias("e"), mean("p", 5).alias("p5"), mean("p", 20).alias("p20"), mean("s", 5).alias("s5"), mean("s", 20).alias("s20"))
    d = d.select("session_id", "n", F.col("e.p").alias("p"), F.col("e.s").alias("s"), "p5", "p20", "s5", "s20", _direction(F.col("p5"), F.col("p20"), "act", "think").alias("phase_direction"), _direction(F.col("s5"), F.col("s20"), "converge", "diverge").alias("scope_direction"))
    steady = (F.col("phase_direction") == "stable") & (F.col("scope_direction") == "stable")
    advice = (
        F.when((F.col("s5") < 0) & (F.col("s20") > 0), "diverging")
        .when(F.col("p") < -0.5, "investigating")
        .when((F.col("p") > 0.5) & (F.col("s") > 0.5) & steady, "focused")
        .when((F.col("s5") > 0) != (F.col("s20") > 0), F.when(F.col("s5") < 0, "entering_diverge").otherwise("entering_converge"))
        .otherwise("mixed")
    )
    return d.select("session_id", "n", F.round("p", 6).alias("ema_phase"), F.round("s", 6).alias("ema_scope"), name(F.col("p"), F.col("s")).alias("stance"), *[F.round(x, 6).alias(y) for x, y in (("p5", "phase_5"), ("p20", "phase_20"), ("s5", "scope_5"), ("s20", "scope_20"))], "phase_direction", "scope_direction", advice.alias("guidance"))


def shifts(t: Tables, *, as_of: int, alpha: float = ALPHA, scan: int = 50, keep: int = 5) -> DataFrame:
    """The last crossings of zero of the scope's average within the last ``scan`` points of each session."""
    series, first = _average(F.col("points"), min(1.0, max(0.01, alpha)), scan)
    d = _points(t).select("session_id", F.size("points").alias("n"), first.alias("first"), series.alias("e"))
    d = d.select("session_id", "n", "first", F.posexplode("e").alias("k", "now")).withColumn("i", F.col("first") + F.col("k"))
    w = Window.partitionBy("session_id").orderBy("i")
    d = d.withColumn("was", F.lag("now").over(w)).where((F.col("i") > F.greatest(F.col("n") - scan, F.lit(0))) & ((F.col("was.s") >= 0) != (F.col("now.s") >= 0)))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("i")))).where(F.col("rn") <= keep)
    minutes = F.round((F.lit(as_of) - F.col("now.t")) / 60.0 * 10) / 10
    return d.select("session_id", F.col("i").cast("long").alias("at_observation"), name(F.col("was.p"), F.col("was.s")).alias("before"), name(F.col("now.p"), F.col("now.s")).alias("after"), minutes.alias("minutes_ago"))
