"""Recency rankings and lookups: recent context, timelines, file and session histories, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.scalar import exp_decay, failed, project_weight, type_weight
from tracelake.model import Tables

DAY = 86400.0


def clamp(limit: int | None, default: int, most: int) -> int:
    return max(1, min(default if limit is None else limit, most))


def with_project(obs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations with their session's project. Spark broadcasts the sessions when their size, which it knows, allows it."""
    return obs.join(sessions.select(F.col("id").alias("session_id"), "project"), "session_id")


def between(df: DataFrame, before: int | None = None, after: int | None = None, column: str = "timestamp") -> DataFrame:
    """An open range of times; None is no bound."""
    if before is not None:
        df = df.where(F.col(column) < before)
    return df if after is None else df.where(F.col(column) > after)


def recent_context(t: Tables, *, as_of: int, project: str | None = None, before: int | None = None, after: int | None = None, limit: int | None = None) -> DataFrame:
    """The best-scored observations, one for each file; those without a file are all kept. With a project, it is a boost.

    Score: recency (half-life of 7 days), type and project weigh .5, .3, .2; without a project recency and type .6, .4.
    """
    o = with_project(between(t.observations, before, after), t.sessions)
    recency, kind = exp_decay((F.lit(as_of) - F.col("timestamp")) / DAY, 7.0), type_weight(F.col("obs_type"))
    score = recency * 0.6 + kind * 0.4 if project is None else recency * 0.5 + kind * 0.3 + project_weight(F.col("project"), project) * 0.2
    o = o.withColumn("score", F.round(score, 6))
    # The best of a file combines before the shuffle. Rows without a file share no group: they would all be one.
    columns = ["id", "timestamp", "project", "obs_type", "file_path", F.substring("content", 1, 120).alias("preview"), "score"]
    o = o.select(columns)
    whole = F.struct("score", "id", *[x for x in o.columns if x not in ("score", "id")])
    files = o.where(F.col("file_path").isNotNull()).groupBy(F.col("file_path").alias("_file")).agg(F.max(whole).alias("x")).select("x.*").select(o.columns)
    n = clamp(limit, 30, 100)
    top = lambda df: df.orderBy(F.desc("score"), F.desc("id")).limit(n)
    return top(top(files).unionByName(top(o.where(F.col("file_path").isNull()))))


def get_observations(t: Tables, ids: list[int]) -> DataFrame:
    """1 to 50 observations in the order of ``ids``; ids that aren't there are left out."""
    if not 1 <= len(ids) <= 50:
        raise ValueError("1 to 50 ids are needed")
    wanted = t.observations.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, position int")
    return t.observations.where(F.col("id").isin(ids)).join(F.broadcast(wanted), "id").orderBy("position")


def timeline(t: Tables, anchor: int, *, before: int = 5, after: int = 5) -> DataFrame:
    """Up to 50 rows before and after an observation, by id within its session, ascending; the anchor itself at side 0."""
    row = t.observations.where(F.col("id") == anchor).select("session_id").first()
    if row is None:
        raise ValueError("anchor observation not found")
    own = t.observations.where(F.col("session_id") == row[0]).select("id", "timestamp", "obs_type", "file_path", F.substring("content", 1, 120).alias("preview"))
    early = own.where(F.col("id") < anchor).orderBy(F.desc("id")).limit(clamp(before, 5, 50)).withColumn("side", F.lit(-1))
    late = own.where(F.col("id") > anchor).orderBy("id").limit(clamp(after, 5, 50)).withColumn("side", F.lit(1))
    return early.unionByName(own.where(F.col("id") == anchor).withColumn("side", F.lit(0))).unionByName(late).orderBy("id")


def session_summaries(t: Tables, *, project: str | None = None, before: int | None = None, after: int | None = None, limit: int | None = None) -> DataFrame:
    s = between(t.sessions.where(F.col("summary").isNotNull()), before, after, "started_at")
    if project is not None:
        s = s.where(F.col("project") == project)
    return s.orderBy(F.desc("started_at"), F.desc("id")).limit(clamp(limit, 10, 100))


def session_head(t: Tables, session_id: str) -> dict:
    """Project, times and summary of a session; one that isn't there is an error."""
    row = t.sessions.where(F.col("id") == session_id).first()
    if row is None:
        raise ValueError("session not found")
    return row.asDict()


def session_trace(t: Tables, session_id: str, *, before: int | None = None, after: int | None = None) -> DataFrame:
    """A session's prompts, each with its observations in order, of an open range of times; those without one under a "system" entry.

    What was the session's own is ``session_head``. A session that isn't there is an error.
    """
    session_head(t, session_id)
    o = between(t.observations.where(F.col("session_id") == session_id), before, after)
    item = F.struct("timestamp", "id", "obs_type", "file_path", F.substring("content", 1, 120).alias("preview"))
    own = o.groupBy("prompt_id").agg(F.array_sort(F.collect_list(item)).alias("observations"), F.min("timestamp").alias("first"))
    p = between(t.prompts.where(F.col("session_id") == session_id), before, after).select(F.col("id").alias("prompt_id"), F.col("timestamp").alias("prompt_timestamp"), "source", F.substring("content", 1, 120).alias("prompt"))
    linked = p.join(own.where(F.col("prompt_id").isNotNull()), "prompt_id", "left").select("prompt_id", "prompt_timestamp", "source", "prompt", "observations")
    loose = own.where(F.col("prompt_id").isNull()).select("prompt_id", F.col("first").alias("prompt_timestamp"), F.lit("system").alias("source"), F.lit(None).cast("string").alias("prompt"), "observations")
    return linked.unionByName(loose).orderBy("prompt_timestamp", F.col("prompt_id").asc_nulls_first())


def file_history(t: Tables, path: str, *, before: int | None = None, after: int | None = None, limit: int | None = None) -> DataFrame:
    """The newest touches of a file, gathered by session, with what its prompt and its session were about."""
    o = between(t.observations.where(F.col("file_path") == path), before, after)
    o = o.orderBy(F.desc("timestamp"), F.desc("id")).limit(clamp(limit, 50, 50))
    user = t.prompts.where(F.col("source") == "user").select(F.col("id").alias("prompt_id"), F.substring("content", 1, 120).alias("prompt"))
    o = o.join(user, "prompt_id", "left")
    item = F.struct("timestamp", "id", "obs_type", "prompt_id", "prompt")
    g = o.groupBy("session_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("touches"), F.max("timestamp").alias("last_touch"), F.count("*").alias("n_touches"))
    s = t.sessions.select(F.col("id").alias("session_id"), "project", "started_at", F.get_json_object("summary", "$.intent").alias("intent"))
    return g.join(s, "session_id").orderBy(F.desc("last_touch"), "session_id")


def status(t: Tables) -> DataFrame:
    """Totals of the three tables, and the newest session."""
    o = t.observations.agg(F.count("*").alias("observations"), F.count_if("is_pinned").alias("pinned"), F.count_if(failed(F.col("metadata"))).alias("failures"))
    s = t.sessions.agg(F.count("*").alias("sessions"), F.count_if(F.col("summary").isNotNull()).alias("summarised"), F.max_by("id", F.struct("started_at", "id")).alias("last_session"))
    return o.crossJoin(s).crossJoin(t.prompts.agg(F.count("*").alias("prompts")))  # three rows of one


def type_counts(t: Tables, limit: int = 5) -> DataFrame:
    return t.observations.groupBy("obs_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "obs_type").limit(limit)


def signatures(t: Tables) -> DataFrame:
    """For each session what it did how often, most frequent first."""
    n = t.observations.groupBy("session_id", "obs_type").agg(F.count("*").alias("n"))
    return n.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "obs_type"))).alias("x")).select("session_id", F.transform("x", lambda x: F.struct(x["obs_type"].alias("obs_type"), (-x["less"]).alias("n"))).alias("signature"))


def latest_prompts(t: Tables) -> DataFrame:
    return t.prompts.groupBy("session_id").agg(F.max("id").alias("prompt_id"))


def link_prompts(obs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Each observation with the newest prompt of its session at its time: an as-of join as one ordered pass over both.

    At equal times the prompt comes first.
    """
    rows = obs.withColumn("_prompt", F.lit(None).cast("long")).unionByName(prompts.select("session_id", "timestamp", F.col("id").alias("_prompt")), allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("timestamp", F.col("_prompt").asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("prompt_id", F.last("_prompt", ignorenulls=True).over(w)).where(F.col("_prompt").isNull()).drop("_prompt")


def deduplicated(obs: DataFrame, seconds: int = 300) -> DataFrame:
    """Without repeats: rows of the type, file and session of one at most ``seconds`` before them."""
    w = Window.partitionBy("session_id", "obs_type", "file_path").orderBy("timestamp", "id")
    return obs.withColumn("_was", F.lag("timestamp").over(w)).where(F.col("_was").isNull() | (F.col("timestamp") - F.col("_was") > seconds)).drop("_was")


def gaps(obs: DataFrame) -> DataFrame:
    """``id, gap_seconds``: the time since the row before in the session."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")
    return obs.select("id", (F.col("timestamp") - F.lag("timestamp").over(w)).alias("gap_seconds"))
