"""Events of a coding agent (JSON, one a line) as sessions, prompts and observations; transcripts; source trees; settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import kernels
from tracelake.functions.scalar import classify_bash, classify_tool, derive_project, extract_content, extract_file_path, git_details
from tracelake.model import HOOKS, Tables
from tracelake.operators import classify
from tracelake.operators.episodes import SENTINEL
from tracelake.operators.ranking import signatures

SESSION_SOURCES = ("compact", "resume", "clear")


@dataclass(frozen=True)
class ContextLimits:
    """What sessions of a project start with: rows of its own and of others (0: none), hours of episodes. None is the usual."""

    local: int | None = None
    cross: int | None = None
    hours: int | None = None


@dataclass(frozen=True)
class Summarization:
    """How a model that is brought along is to be asked for summaries (see ``episodes.payload``)."""

    enabled: bool = False
    model_path: str | None = None
    adapter_path: str | None = None
    temperature: float = 0.0
    max_tokens: int | None = None
    context_tokens: int | None = None


@dataclass(frozen=True)
class Beacon:
    """An instance among others: what it is called, whether it answers searches and with how many rows (see ``fleet.answer``)."""

    org: str | None = None
    identity: str | None = None
    respond: bool = True
    limit: int = 20


@dataclass
class Settings:
    sensitivity: str = "normal"
    extra_patterns: tuple[str, ...] = ()
    entropy_threshold: float | None = None
    entropy_min_length: int | None = None
    disable_entropy: bool = False
    #: Sensitivity of single projects, by name.
    projects: dict[str, str] = field(default_factory=dict)
    retention_enabled: bool = False
    retention_days: dict[str, int] = field(default_factory=dict)
    home: str = "/root"
    contexts: dict[str, ContextLimits] = field(default_factory=dict)
    summarization: Summarization = Summarization()
    beacon: Beacon = Beacon()


def settings(text: str) -> Settings:
    """From TOML. Unknown keys are ignored; single limits of entropy win over the sensitivity, a project's over the general one."""
    t = tomllib.loads(text)
    f, r, m, b = (t.get(x, {}) for x in ("filter", "retention", "summarization", "beacon"))
    own = {name: ContextLimits(p.get("context_local_limit"), 0 if p.get("suppress_cross_project") else p.get("context_cross_limit"), p.get("context_episode_window_hours")) for name, p in t.get("projects", {}).items()}
    return Settings(
        sensitivity=f.get("sensitivity", "normal"),
        extra_patterns=tuple(f.get("extra_patterns", ())),
        entropy_threshold=f.get("entropy_threshold"),
        entropy_min_length=f.get("entropy_min_length"),
        disable_entropy=bool(f.get("disable_entropy", False)),
        projects={name: "normal" if p["sensitivity"] == "default" else p["sensitivity"] for name, p in t.get("projects", {}).items() if "sensitivity" in p},
        retention_enabled=bool(r.get("enabled", False)),
        retention_days=dict(r.get("days", {})),
        home=t.get("project", {}).get("home", "/root"),
        contexts={name: x for name, x in own.items() if x != ContextLimits()},
        summarization=Summarization(bool(m.get("enabled", False)), m.get("model_path"), m.get("lora_path"), float(m.get("temperature", 0.0)), m.get("max_tokens"), m.get("n_ctx")),
        beacon=Beacon(b.get("org"), b.get("identity"), bool(b.get("respond", True)), int(b.get("limit", 20))),
    )


def redacted(text: Column, cwd: Column, s: Settings) -> Column:
    """Text without secrets, under the limits of the project of its folder."""
    limits = lambda x: kernels.entropy_limits(x, s.entropy_threshold, s.entropy_min_length, not s.disable_entropy)
    out = kernels.redact(text, extra=s.extra_patterns, limits=limits(s.sensitivity))
    project = derive_project(cwd, F.lit(None).cast("string"), s.home)
    for own in dict.fromkeys(map(limits, s.projects.values())):
        if own != limits(s.sensitivity):
            out = F.when(project.isin([p for p, x in s.projects.items() if limits(x) == own]), kernels.redact(text, extra=s.extra_patterns, limits=own)).otherwise(out)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines: nested values come as their JSON text, unknown fields are ignored, malformed lines are null."""
    return spark.read.schema(HOOKS).json(path)


def stamped(events: DataFrame, timestamp: str) -> DataFrame:
    """Events of a session, with the time of each in seconds (``t``)."""
    return events.where(F.col("session_id").isNotNull() & (F.col("session_id") != "")).withColumn("t", F.col(timestamp).cast("long"))


def sessions(events: DataFrame, s: Settings) -> DataFrame:
    """A row for each session: project of its first event, span, whether it has been stopped."""
    e = events.groupBy(F.col("session_id").alias("id")).agg(F.min_by("cwd", "t").alias("cwd"), F.min("t").alias("started_at"), F.max(F.when(F.col("hook_event_name") == "Stop", F.col("t"))).alias("ended_at"))
    return e.select("id", derive_project(F.col("cwd"), F.lit(None).cast("string"), s.home).alias("project"), "started_at", "ended_at")


def starts(events: DataFrame, s: Settings) -> DataFrame:
    """``session_id, project, t, recovery, local_limit, cross_limit, hours`` of each start of a session, new or not."""
    e = events.where(F.col("hook_event_name") == "SessionStart").select("session_id", derive_project(F.col("cwd"), F.lit(None).cast("string"), s.home).alias("project"), "t", F.coalesce(F.col("source").isin("compact", "clear"), F.lit(False)).alias("recovery"))

    def own(name: str) -> Column:
        out = F.lit(None).cast("long")
        for project, x in s.contexts.items():
            out = F.when(F.col("project") == project, F.lit(getattr(x, name)).cast("long")).otherwise(out)
        return out

    return e.select("*", own("local").alias("local_limit"), own("cross").alias("cross_limit"), own("hours").alias("hours"))


def start_contexts(events: DataFrame, timestamp: str, t: Tables, s: Settings | None = None) -> DataFrame:
    """The context that each start among events is given (see ``start_context.at_starts``), out of the tables as of its time."""
    from tracelake.operators import start_context

    s = s or Settings()
    return start_context.at_starts(t, starts(stamped(events, timestamp), s))


def prompts(events: DataFrame, s: Settings) -> DataFrame:
    """What users said, 2000 characters of it, without the system's reminders, redacted. The id is of session, time and text."""
    e = events.where((F.col("hook_event_name") == "UserPromptSubmit") & F.col("prompt").isNotNull() & (F.trim("prompt") != "") & ~F.col("prompt").startswith("<system-reminder>"))
    text = redacted(F.substring("prompt", 1, 2000), F.col("cwd"), s)
    return e.select(F.xxhash64("session_id", "t", "prompt").alias("id"), "session_id", F.col("t").alias("timestamp"), F.lit("user").alias("source"), text.alias("content"))


def observations(events: DataFrame, s: Settings) -> DataFrame:
    """Tool uses and what sessions went through: extracted, classified, redacted and labelled in one projection."""
    use = events.where(F.col("hook_event_name").isin("PostToolUse", "PostToolUseFailure"))
    kind = F.when(F.col("tool_name") == "Bash", classify_bash(F.coalesce(F.get_json_object("tool_input", "$.command"), F.lit("")))).otherwise(classify_tool(F.col("tool_name")))
    failed = F.col("hook_event_name") == "PostToolUseFailure"
    use = use.select("session_id", "t", "cwd", "tool_name", F.col("hook_event_name").alias("source_event"), kind.alias("obs_type"), extract_file_path(F.col("tool_name"), F.col("tool_input")).alias("file_path"), extract_content(F.col("tool_name"), F.col("tool_input")).alias("raw"), failed.alias("failed"), F.substring(F.coalesce("tool_response", F.lit("")), 1, 2000).alias("raw_response"))
    start = events.where((F.col("hook_event_name") == "SessionStart") & F.col("source").isin(*SESSION_SOURCES))
    kind = F.concat(F.lit("session_"), F.col("source"))
    start = start.select("session_id", "t", "cwd", F.lit(None).cast("string").alias("tool_name"), F.col("hook_event_name").alias("source_event"), kind.alias("obs_type"), F.lit(None).cast("string").alias("file_path"), kind.alias("raw"), F.lit(False).alias("failed"), F.lit("").alias("raw_response"))
    o = use.unionByName(start)
    o = o.withColumn("content", redacted(F.col("raw"), F.col("cwd"), s)).withColumn("response", redacted(F.col("raw_response"), F.col("cwd"), s))
    git = git_details(F.col("obs_type"), F.col("response"))
    metadata = F.to_json(F.struct(F.when(F.col("content") != F.col("raw"), True).alias("redacted"), F.when(F.col("failed"), True).alias("failed"), F.when(F.col("failed") & (F.col("response") != ""), F.col("response")).alias("response"), *[git[x].alias(x) for x in ("branch", "commit_hash", "commit_message", "files_changed", "insertions", "deletions", "new_files", "remote_url", "hash_range")]))
    return o.select(
        F.xxhash64("session_id", "t", "obs_type", "raw", "source_event").alias("id"),
        "session_id",
        F.lit(None).cast("long").alias("prompt_id"),
        F.col("t").alias("timestamp"),
        "obs_type",
        "source_event",
        "tool_name",
        "file_path",
        "content",
        F.when(metadata != "{}", metadata).alias("metadata"),
        F.lit(False).alias("is_pinned"),
        F.lit(None).cast("string").alias("phase"),
        F.lit(None).cast("string").alias("scope"),
        classify.locus(F.col("obs_type"), F.col("content"), F.col("file_path")).alias("locus"),
        classify.novelty(F.col("obs_type"), F.col("content"), F.col("file_path")).alias("novelty"),
        F.lit(None).cast("string").alias("friction"),
    )


def ingest(events: DataFrame, timestamp: str, s: Settings | None = None, models: dict[str, dict] | None = None) -> Tables:
    """Events as tables; each observation has the newest prompt of its session at its time; ended sessions are closed.

    ``models`` (of phase, scope and others, see ``classify``) label what the rules leave open.
    """
    from tracelake.operators.ranking import link_prompts

    s = s or Settings()
    e = stamped(events, timestamp)
    p, o = prompts(e, s), observations(e, s)
    o = link_prompts(o if models is None else classify.backfill(o, models), p)
    return close(Tables(sessions=sessions(e, s), prompts=p, observations=o))


def close(t: Tables, least: int = 3) -> Tables:
    """Signatures for ended sessions, and a fixed summary for those with hardly any observations."""
    from dataclasses import replace

    sig = signatures(t).withColumnRenamed("session_id", "_s")
    n = t.observations.groupBy(F.col("session_id").alias("_n_s")).agg(F.count("*").alias("_n"))
    x = t.sessions.join(sig, F.col("id") == F.col("_s"), "left").join(n, F.col("id") == F.col("_n_s"), "left")
    ended = F.col("ended_at").isNotNull()
    x = x.select(*t.sessions.columns, F.when(ended, F.col("signature")).alias("signature"), F.when(ended & (F.coalesce("_n", F.lit(0)) < least), SENTINEL).alias("summary"))
    return replace(t, sessions=x)


def transcript(lines: DataFrame, have: DataFrame | None = None, from_line: int = 0) -> DataFrame:
    """An agent's thoughts from a transcript's lines (``session_id, line, t, value``) after a cursor, 2000 characters each.

    Thoughts that the prompts have already (same session, source and text) are left out, of equal new ones the first stays.
    """
    kind = "type string, message struct<content:array<struct<type:string,thinking:string>>>"
    x = lines.where(F.col("line") > from_line).withColumn("m", F.from_json("value", kind)).where(F.col("m.type") == "assistant")
    x = x.select("session_id", "line", "t", F.explode("m.message.content").alias("c")).where(F.col("c.type") == "thinking")
    x = x.select("session_id", F.col("t").alias("timestamp"), "line", F.substring(F.trim("c.thinking"), 1, 2000).alias("content")).where("content != ''")
    x = x.groupBy("session_id", "content").agg(F.min(F.struct("line", "timestamp")).alias("at"))
    x = x.select(F.xxhash64("session_id", "content").alias("id"), "session_id", F.col("at.timestamp").alias("timestamp"), F.lit("agent").alias("source"), "content")
    return x if have is None else x.join(have.where("source = 'agent'").select("session_id", "content"), ["session_id", "content"], "left_anti").select(*x.columns)


def rust_modules(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules ``module, path, lines, items, functions, types``, uses ``module, uses``) from source texts ``path, text``."""
    f = files.select(F.replace(F.regexp_replace("path", r"\.rs$", ""), F.lit("/src/"), F.lit("/")).alias("module"), "path", "text", F.split("text", "\n").alias("all"))
    code = F.filter("all", lambda x: ~F.trim(x).startswith("//"))
    f = f.withColumn("code", code)
    found = lambda pattern: F.filter(F.transform("code", lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
    f = f.withColumn("functions", found(r"^\s*pub\s+(?:async\s+)?fn\s+(\w+)")).withColumn("types", found(r"^\s*pub\s+(?:struct|enum|trait|type|const|static)\s+(?!fn\b)(\w+)"))
    uses = f.select("module", F.explode(F.array_distinct(F.regexp_extract_all(F.array_join("code", "\n"), F.lit(r"use\s+crate::(\w+)"), F.lit(1)))).alias("uses"))
    lines = F.size("all") - F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 1).otherwise(0)
    return f.select("module", "path", lines.cast("long").alias("lines"), (F.size("functions") + F.size("types")).cast("long").alias("items"), "functions", "types"), uses
