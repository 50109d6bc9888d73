"""What a session starts with: recent episodes, older summaries, suggested tasks, activity here and pins elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalar import low_quality_intent, phase_label, relative_time
from tracelake.model import Tables
from tracelake.operators.ranking import between, with_project

WINDOW_HOURS, EPISODES, SUMMARIES, TASKS = 48, 15, 5, 5
#: (local, cross-project) rows, usually and after a session was compacted.
LIMITS, RECOVERY_LIMITS = (20, 10), (30, 15)


def _own(t: Tables, project: str) -> DataFrame:
    return t.sessions.where(F.col("project") == project).select(F.col("id").alias("session_id"), F.col("summary").alias("session_summary"))


def episode_title() -> Column:
    """An episode's intent, or its session's if it is poor."""
    better = F.get_json_object("session_summary", "$.intent")
    return F.substring(F.when(low_quality_intent(F.coalesce("intent", F.lit(""))) & better.isNotNull(), better).otherwise(F.col("intent")), 1, 120)


def learned() -> Column:
    """What a summary says was learned, three of its items if it is a list."""
    x = F.get_json_object("summary", "$.learned")
    return F.when(x.startswith("["), F.array_join(F.slice(F.from_json(x, "array<string>"), 1, 3), "; ")).otherwise(x)


def recent_episodes(t: Tables, project: str, *, as_of: int, window_hours: int = WINDOW_HOURS, limit: int = EPISODES) -> DataFrame:
    """Newest episodes of a project in the window before ``as_of``; a poor intent gives way to its session's."""
    w = t.work_units.where((F.col("started_at") >= as_of - window_hours * 3600) & (F.col("started_at") < as_of) & (F.col("obs_count") > 0))
    w = w.join(_own(t, project), "session_id").orderBy(F.desc("started_at"), "session_id", "episode").limit(limit)
    return w.select("session_id", "episode", "started_at", episode_title().alias("title"), "obs_count", phase_label(F.col("phase_signature")).alias("label"), "hot_files", learned().alias("learned"))


def fallback_summaries(t: Tables, project: str, *, as_of: int, window_hours: int = WINDOW_HOURS, limit: int = SUMMARIES) -> DataFrame:
    """Newest summaries of sessions from before the window, or without any episode."""
    s = t.sessions.where((F.col("project") == project) & F.col("summary").isNotNull() & (F.col("started_at") < as_of))
    has = t.work_units.select(F.col("session_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    s = s.join(has, "id", "left").where((F.col("started_at") < as_of - window_hours * 3600) | F.col("_has").isNull()).drop("_has")
    return s.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def suggested_tasks(t: Tables, project: str, *, as_of: int | None = None, limit: int = TASKS) -> DataFrame:
    """Next steps of the newest session, then of the five newest episodes, each text once, in that order; of before ``as_of`` if given."""
    s = between(t.sessions.where((F.col("project") == project) & F.col("summary").isNotNull()), as_of, column="started_at").orderBy(F.desc("started_at"), F.desc("id")).limit(1)
    steps = lambda c: F.posexplode(F.from_json(F.get_json_object(c, "$.next_steps"), "array<string>")).alias("i", "task")
    rows = s.select(F.lit(0).alias("source"), F.lit(0).alias("rank"), steps("summary"))
    if t.work_units is not None:
        from pyspark.sql import Window

        w = between(t.work_units, as_of, column="started_at").where(F.col("summary").isNotNull()).join(_own(t, project), "session_id").orderBy(F.desc("started_at"), "session_id", "episode").limit(5)
        w = w.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("started_at"), "session_id", "episode")))  # five rows
        rows = rows.unionByName(w.select(F.lit(1).alias("source"), "rank", steps("summary")))
    first = rows.groupBy("task").agg(F.min(F.struct("source", "rank", "i")).alias("at"))
    return first.orderBy("at").limit(limit).select("task")


def local_activity(t: Tables, project: str, *, as_of: int, recovery: bool = False) -> DataFrame:
    """Pinned rows, edits of the last two hours and pushed or committed work of the last day; pinned and newest first."""
    o = between(with_project(t.observations, t.sessions), before=as_of).where(F.col("project") == project)
    recent = (F.col("obs_type") == "file_edit") & (F.col("timestamp") > as_of - 7200) | F.col("obs_type").isin("git_commit", "git_push") & (F.col("timestamp") > as_of - 86400)
    o = o.where(F.col("is_pinned") | recent).orderBy(F.desc("is_pinned"), F.desc("timestamp"), F.desc("id"))
    return o.limit((RECOVERY_LIMITS if recovery else LIMITS)[0]).select("id", "timestamp", "obs_type", "file_path", "content", "is_pinned")


def cross_project_pins(t: Tables, project: str, *, as_of: int, recovery: bool = False) -> DataFrame:
    o = between(with_project(t.observations, t.sessions), before=as_of).where((F.col("project") != project) & F.col("is_pinned"))
    return o.orderBy(F.desc("timestamp"), F.desc("id")).limit((RECOVERY_LIMITS if recovery else LIMITS)[1]).select("id", "timestamp", "obs_type", "file_path", "content", "is_pinned", "project")


def stands_alone() -> Column:
    """Whether an action has a line of its own."""
    return F.col("is_pinned") | F.col("obs_type").isin("git_commit", "git_push") | F.col("file_path").isNull()


def single_title() -> Column:
    title = F.coalesce("file_path", F.when(F.char_length("content") > 60, F.concat(F.substring("content", 1, 60), F.lit("..."))).otherwise(F.col("content")), F.lit("?"))
    return F.concat(title, F.when(F.col("is_pinned"), " (pinned)").otherwise(""))


def edits_title() -> Column:
    return F.concat(F.col("file_path"), F.when(F.col("n") > 1, F.concat(F.lit(" — "), F.col("n").cast("string"), F.lit(" edits"))).otherwise(""))


def activity_line(as_of: Column) -> Column:
    return F.concat(F.lit("- "), F.replace("title", F.lit("|"), F.lit("\\|")), F.lit(" ("), relative_time(F.col("timestamp"), as_of), F.lit(")"))


def activity_lines(rows: DataFrame, *, as_of: int) -> DataFrame:
    """Edits by file with their number; pinned rows and git work alone. Newest first within each kind."""
    alone = stands_alone()
    grouped = rows.where(~alone).groupBy("file_path").agg(F.count("*").alias("n"), F.max("timestamp").alias("timestamp")).select(F.lit(0).alias("part"), "timestamp", F.lit(None).cast("long").alias("id"), edits_title().alias("title"))
    single = rows.where(alone).select(F.lit(1).alias("part"), "timestamp", "id", single_title().alias("title"))
    return grouped.unionByName(single).withColumn("line", activity_line(F.lit(as_of))).orderBy("part", F.desc("timestamp"), "title")


def render(t: Tables, project: str, *, as_of: int, recovery: bool = False) -> str:
    """The five parts as Markdown, each from a small collected frame; empty if all but the tasks are empty."""
    parts = {"## Recent Episodes": [], "## Earlier Sessions": [], "## Suggested Tasks": [], "## Recent Activity": [], "## Pinned Elsewhere": []}
    for i, r in enumerate(recent_episodes(t, project, as_of=as_of).collect()):
        parts["## Recent Episodes"].append(f"- {r.title or '?'} [{r.label or '?'}, {r.obs_count} actions]")
        if i < 3 and r.hot_files:
            parts["## Recent Episodes"].append(f"  files: {', '.join(r.hot_files[:5])}")
        if i < 3 and r.learned:
            parts["## Recent Episodes"].append(f"  learned: {r.learned}")
    parts["## Earlier Sessions"] = [f"- {r[0]}" for r in fallback_summaries(t, project, as_of=as_of).select(F.coalesce(F.get_json_object("summary", "$.intent"), F.lit("?"))).collect()]
    parts["## Suggested Tasks"] = [f"- {r.task}" for r in suggested_tasks(t, project, as_of=as_of).collect()]
    parts["## Recent Activity"] = [r.line for r in activity_lines(local_activity(t, project, as_of=as_of, recovery=recovery), as_of=as_of).collect()]
    parts["## Pinned Elsewhere"] = [f"{r.line}" for r in activity_lines(cross_project_pins(t, project, as_of=as_of, recovery=recovery), as_of=as_of).collect()]
    if not any(v for k, v in parts.items() if k != "## Suggested Tasks"):
        return ""
    return "\n".join("\n".join([k, *v]) for k, v in parts.items() if v) + "\n"


def pattern_report(patterns: DataFrame) -> str:
    """Patterns by kind as Markdown (at most 80 rows)."""
    out = ["# Patterns"]
    rows = patterns.orderBy("kind", F.desc("heat"), "pattern").collect()
    for kind in dict.fromkeys(r.kind for r in rows):
        out += ["", f"## {kind.replace('_', ' ').title()}", ""]
        out += [f"- `{r.pattern}` — {r.session_count} sessions, heat {r.heat:.0f}" for r in rows if r.kind == kind]
    return "\n".join(out) + "\n"
