"""Retention and changes as functions from tables to tables: sweep, purge, orphans, pins, markers, tasks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.kernels import parse_day
from tracelake.model import Tables

# Days for which a type is kept; types that aren't named are kept for good.
RETENTION_DAYS = {
    "git_commit": 730,
    "git_push": 730,
    "file_write": 365,
    "file_edit": 365,
    "session_startup": 365,
    "session_compact": 365,
    "session_resume": 365,
    "session_clear": 365,
    "command": 180,
    "github": 180,
    "file_read": 90,
    "search": 90,
    "mcp_call": 90,
    "web_fetch": 90,
    "web_search": 90,
    "task_spawn": 90,
    "tool_other": 90,
}


def expired(t: Tables, *, as_of: int, days: dict[str, int] | None = None) -> DataFrame:
    """Observations whose type's time is over, that aren't pinned and whose session has a summary."""
    days = RETENTION_DAYS if days is None else days
    limit = F.lit(None).cast("long")
    for kind, n in days.items():
        limit = F.when(F.col("obs_type") == kind, as_of - n * 86400).otherwise(limit)
    summarised = t.sessions.where(F.col("summary").isNotNull()).select(F.col("id").alias("session_id"))
    return t.observations.where((F.col("timestamp") < limit) & ~F.col("is_pinned")).join(summarised, "session_id", "left_semi")


def sweep(t: Tables, *, as_of: int, days: dict[str, int] | None = None) -> Tables:
    """The tables without expired observations and what is left alone by that."""
    gone = expired(t, as_of=as_of, days=days).select("id")
    return without_orphans(replace(t, observations=t.observations.join(gone, "id", "left_anti")))


def swept_by_type(t: Tables, *, as_of: int, days: dict[str, int] | None = None) -> DataFrame:
    return expired(t, as_of=as_of, days=days).groupBy("obs_type").agg(F.count("*").alias("deleted"))


def orphans(t: Tables) -> DataFrame:
    """Sessions that neither observations nor prompts speak of any more."""
    used = t.observations.select("session_id").union(t.prompts.select("session_id")).distinct()
    return t.sessions.join(used, F.col("id") == used["session_id"], "left_anti")


def without_orphans(t: Tables) -> Tables:
    """No session without rows, no prompt of a session that isn't there."""
    used = t.observations.select(F.col("session_id").alias("id")).union(t.prompts.select(F.col("session_id").alias("id"))).distinct()
    return replace(t, sessions=t.sessions.join(used, "id", "left_semi"))


def purge_matches(t: Tables, *, as_of: int, ids: list[int] | None = None, session: str | None = None, project: str | None = None, before: str | None = None, obs_type: str | None = None, older_than_days: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """Observations that meet all given conditions (``found``: ids of a search); none given is an error."""
    if all(x is None for x in (ids, session, project, before, obs_type, older_than_days, found)):
        raise ValueError("a purge needs a condition")
    o = t.observations
    if ids is not None:
        o = o.where(F.col("id").isin(ids))
    if session is not None:
        o = o.where(F.col("session_id") == session)
    if before is not None:
        o = o.where(F.col("timestamp") < parse_day(before))
    if obs_type is not None:
        o = o.where(F.col("obs_type") == obs_type)
    if older_than_days is not None:
        o = o.where(F.col("timestamp") < as_of - older_than_days * 86400)
    if project is not None:
        o = o.join(t.sessions.where(F.col("project") == project).select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return o if found is None else o.join(found.select(F.col("doc").alias("id")), "id", "left_semi")


def purge(t: Tables, matches: DataFrame) -> Tables:
    """The tables without the matching observations, orphaned sessions, and links to prompts that are gone."""
    kept = t.observations.join(matches.select("id"), "id", "left_anti")
    out = without_orphans(replace(t, observations=kept))
    have = out.prompts.select(F.col("id").alias("_p"))
    linked = kept.join(have, F.col("prompt_id") == F.col("_p"), "left").withColumn("prompt_id", F.when(F.col("_p").isNotNull(), F.col("prompt_id"))).drop("_p")
    return replace(out, observations=linked)


def delete_sessions(t: Tables, sessions: DataFrame) -> Tables:
    """Without the given sessions (``id``) and all that belongs to them."""
    gone = sessions.select(F.col("id").alias("_gone")).distinct()
    cut = lambda df, col: None if df is None else df.join(gone, F.col(col) == F.col("_gone"), "left_anti")
    return replace(t, sessions=cut(t.sessions, "id"), prompts=cut(t.prompts, "session_id"), observations=cut(t.observations, "session_id"), work_units=cut(t.work_units, "session_id"))


def pin(t: Tables, obs_id: int, pinned: bool = True) -> Tables:
    if t.observations.where(F.col("id") == obs_id).isEmpty():
        raise ValueError("observation not found")
    return replace(t, observations=t.observations.withColumn("is_pinned", F.when(F.col("id") == obs_id, F.lit(pinned)).otherwise(F.col("is_pinned"))))


def mark(t: Tables, text: str, project: str, *, as_of: int) -> Tables:
    """Adds a marker to the newest session of a project, or to a new session ``mark-<time>``."""
    newest = t.sessions.where(F.col("project") == project).orderBy(F.desc("started_at"), F.desc("id")).select("id").first()
    session, spark = (newest[0] if newest else f"mark-{as_of}"), t.sessions.sparkSession
    sessions = t.sessions if newest else t.sessions.unionByName(spark.createDataFrame([(session, project, as_of)], "id string, project string, started_at long"), allowMissingColumns=True)
    next_id = (t.observations.agg(F.max("id")).first()[0] or 0) + 1
    row = spark.createDataFrame([(next_id, session, as_of, "marker", "AgentMarker", text, False)], "id long, session_id string, timestamp long, obs_type string, source_event string, content string, is_pinned boolean")
    return replace(t, sessions=sessions, observations=t.observations.unionByName(row, allowMissingColumns=True))


def eligible_tasks(tasks: DataFrame, *, as_of: int, most: int, alive: DataFrame | None = None) -> DataFrame:
    """Pending tasks that are due, oldest first, as many as there are free slots; running ones whose pane is gone don't count."""
    running = tasks.where(F.col("status") == "running")
    if alive is not None:
        running = running.join(alive.select("tmux_target"), "tmux_target", "left_semi")
    slots = max(0, most - running.count())
    due = tasks.where((F.col("status") == "pending") & (F.col("run_after").isNull() | (F.col("run_after") <= as_of)))
    return due.orderBy("created_at", "id").limit(slots)


def reap(tasks: DataFrame, alive: DataFrame, *, as_of: int) -> DataFrame:
    """Running tasks whose pane is gone are completed."""
    a = alive.select(F.col("tmux_target").alias("_t"), F.lit(True).alias("_alive")).distinct()
    done = (F.col("status") == "running") & F.col("_alive").isNull()
    return tasks.join(a, F.col("tmux_target") == F.col("_t"), "left").withColumn("completed_at", F.when(done, F.lit(as_of)).otherwise(F.col("completed_at"))).withColumn("status", F.when(done, "completed").otherwise(F.col("status"))).drop("_t", "_alive")


def task(tasks: DataFrame, task_id: int) -> DataFrame:
    """One task with a word for its state."""
    out = tasks.where(F.col("id") == task_id)
    if out.isEmpty():
        raise ValueError("task not found")
    return out.withColumn("state", F.when(F.col("error").isNotNull(), "failed").when((F.col("status") == "pending") & F.col("run_after").isNotNull(), "scheduled").otherwise(F.col("status")))


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose keys aren't there yet; of new rows with equal keys one."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def maintain(t: Tables, *, as_of: int, days: dict[str, int] | None = None, retention: bool = True, least: int = 3) -> Tables:
    """What is due at the end of sessions, in one plan: episodes of sessions that have none are added, ended sessions without a summary
    get one (a fixed one if there is little to say), then what has expired goes."""
    from tracelake.operators import episodes

    found = episodes.annotate(t, episodes.detect(t)).select("*", F.lit(None).cast("string").alias("summary"))
    units = found if t.work_units is None else episodes.store(t.work_units, found)
    made = episodes.template_summary(episodes.payload(t, least=least)).select(F.col("session_id").alias("_s"), F.col("summary").alias("_summary"))
    s = t.sessions.join(made, F.col("id") == F.col("_s"), "left")
    due = F.col("ended_at").isNotNull() & F.col("summary").isNull()
    s = s.withColumn("summary", F.when(due, F.coalesce("_summary", F.lit(episodes.SENTINEL))).otherwise(F.col("summary"))).select(t.sessions.columns)
    out = replace(t, sessions=s, work_units=units)
    return sweep(out, as_of=as_of, days=days) if retention else out
