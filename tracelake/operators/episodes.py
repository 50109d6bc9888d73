"""Work episodes: detection from prompts, annotation with observations, friction, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.scalar import failed, friction_label, intent_keywords, word_count
from tracelake.model import Tables

SIMILAR, TERSE = 0.15, 5
COUNTERS = ("investigate", "execute", "failures", "diverge", "converge", "internal", "external", "routine", "novel", "smooth", "friction")
READING, DOING = ("file_read", "search", "web_search", "web_fetch"), ("file_edit", "file_write", "git_commit", "git_push", "command")


def detect(t: Tables) -> DataFrame:
    """``session_id, episode, started_at, ended_at, intent, first_prompt_id, last_prompt_id`` from the users' prompts.

    A fold over each session's prompts in order of id: a terse prompt goes on, so does one whose keywords are like the
    episode's (which then has both), any other opens an episode. One that a terse prompt opens has no keywords.
    """
    p = t.prompts.where(F.col("source") == "user")
    p = p.select("session_id", F.struct("id", "timestamp", "content", (word_count(F.col("content")) < TERSE).alias("terse"), F.array_distinct(intent_keywords(F.col("content"))).alias("words")).alias("p"))
    p = p.groupBy("session_id").agg(F.array_sort(F.collect_list("p")).alias("prompts"))
    new = lambda x: F.struct(x["timestamp"].alias("started_at"), x["timestamp"].alias("ended_at"), x["content"].alias("intent"), x["id"].alias("first_prompt_id"), x["id"].alias("last_prompt_id"))
    more = lambda e, x: F.struct(e["started_at"], x["timestamp"].alias("ended_at"), e["intent"], e["first_prompt_id"], x["id"].alias("last_prompt_id"))
    kind = "struct<started_at:bigint,ended_at:bigint,intent:string,first_prompt_id:bigint,last_prompt_id:bigint>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"), F.array().cast("array<string>").alias("words"))

    def step(a: Column, x: Column) -> Column:
        alike = F.size(F.array_intersect(a["words"], x["words"])) >= F.greatest(F.size(F.array_union(a["words"], x["words"])), F.lit(1)) * SIMILAR
        first = F.struct(a["done"].alias("done"), new(x).alias("open"), F.when(x["terse"], F.array().cast("array<string>")).otherwise(x["words"]).alias("words"))
        on = F.struct(a["done"].alias("done"), more(a["open"], x).alias("open"), F.when(x["terse"], a["words"]).otherwise(F.array_union(a["words"], x["words"])).alias("words"))
        other = F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), new(x).alias("open"), x["words"].alias("words"))
        return F.when(a["open"].isNull(), first).when(x["terse"] | alike, on).otherwise(other)

    found = F.aggregate("prompts", start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    d = p.select("session_id", F.posexplode(found).alias("i", "e"))
    return d.select("session_id", (F.col("i") + 1).cast("long").alias("episode"), "e.started_at", "e.ended_at", "e.intent", "e.first_prompt_id", "e.last_prompt_id")


def members(episodes: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of each episode: an equi-join on the session with a range of prompts."""
    e = episodes.select("session_id", "episode", "first_prompt_id", "last_prompt_id")
    return observations.join(e, "session_id").where(F.col("prompt_id").between(F.col("first_prompt_id"), F.col("last_prompt_id")))


def counters() -> list[Column]:
    phase = F.coalesce(F.col("phase"), F.when(F.col("obs_type").isin(*READING), "think").when(F.col("obs_type").isin(*DOING), "act"))
    of = {"investigate": phase == "think", "execute": phase == "act", "failures": failed(F.col("metadata"))}
    of |= {v: F.col(c) == v for c, v in (("scope", "diverge"), ("scope", "converge"), ("locus", "internal"), ("locus", "external"), ("novelty", "routine"), ("novelty", "novel"), ("friction", "smooth"), ("friction", "friction"))}
    return [F.count_if(of[c]).alias(c) for c in COUNTERS]


def trace() -> Column:
    """The observations of a group in order, as JSON in which null fields are left out."""
    item = F.struct(F.col("timestamp").alias("t"), F.col("id"), F.struct(F.col("timestamp").alias("t"), F.col("obs_type").alias("type"), F.col("file_path").alias("fp"), F.col("phase").alias("p"), F.col("scope").alias("s"), F.col("locus").alias("l"), F.col("novelty").alias("n"), F.col("friction").alias("f"), F.when(failed(F.col("metadata")), True).alias("fail")).alias("x"))
    return F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]))


def annotate(t: Tables, episodes: DataFrame) -> DataFrame:
    """Episodes with their files, counters, number of observations and trace; those without observations are dropped."""
    g = members(episodes, t.observations).groupBy("session_id", "episode").agg(F.array_sort(F.collect_set("file_path")).alias("hot_files"), *counters(), F.count("*").alias("obs_count"), trace().alias("obs_trace"))
    g = g.withColumn("phase_signature", F.struct(*COUNTERS)).drop(*COUNTERS)
    return episodes.join(g, ["session_id", "episode"])


def label_friction(t: Tables, work_units: DataFrame) -> DataFrame:
    """Observations with the friction of the episode they are in, or none."""
    e = work_units.select(F.col("session_id").alias("_s"), F.col("first_prompt_id").alias("_a"), F.col("last_prompt_id").alias("_b"), friction_label(F.col("phase_signature.failures")).alias("_f"))
    o = t.observations
    on = (o["session_id"] == e["_s"]) & o["prompt_id"].between(e["_a"], e["_b"])
    return o.join(e, on, "left").withColumn("friction", F.col("_f")).drop("_s", "_a", "_b", "_f")


def store(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the episodes of sessions that have none yet: doing it again changes nothing."""
    return old.unionByName(new.join(old.select("session_id").distinct(), "session_id", "left_anti"), allowMissingColumns=True)


def backfill_traces(t: Tables, work_units: DataFrame) -> DataFrame:
    """Fills missing traces of episodes that have observations."""
    todo = work_units.where(F.col("obs_trace").isNull())
    made = members(todo, t.observations).groupBy("session_id", "episode").agg(trace().alias("_trace"))
    return work_units.join(made, ["session_id", "episode"], "left").withColumn("obs_trace", F.coalesce("obs_trace", "_trace")).drop("_trace")


def _first(rows: DataFrame, by: list[str], order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows of each group (all if None), cut within each task before they are shuffled."""
    if n is None:
        return rows
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def payload(t: Tables, *, prompts: int | None = None, agent: int = 5, agent_chars: int = 200, actions: int = 50, least: int = 3) -> DataFrame:
    """What a summary of each session is made from: prompts, some of the agent's thoughts, its first actions, as one text."""
    kinds = (("user", prompts), ("agent", agent))
    p = [_first(t.prompts.where(F.col("source") == s).select("session_id", "source", "timestamp", "id", "content"), ["session_id"], ["timestamp", "id"], n) for s, n in kinds]
    p = p[0].unionByName(p[1]).groupBy("session_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct("timestamp", "id", "content")))).alias(s) for s, _ in kinds])
    line = F.concat(F.lit("["), F.col("obs_type"), F.lit("] "), F.coalesce("file_path", F.substring("content", 1, 120)))
    n = t.observations.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    o = _first(t.observations.select("session_id", "timestamp", "id", line.alias("line")), ["session_id"], ["timestamp", "id"], actions)
    o = o.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "line"))).alias("actions")).join(n, "session_id")
    text = F.concat_ws("\n", F.transform("user", lambda x: F.concat(F.lit("user: "), x["content"])), F.transform("agent", lambda x: F.concat(F.lit("agent: "), F.substring(x["content"], 1, agent_chars))), F.transform("actions", lambda x: x["line"]))
    return o.join(p, "session_id", "left").select("session_id", F.col("n").alias("obs_count"), text.alias("payload"))


def episode_payload(t: Tables, work_units: DataFrame, *, prompts: int = 10, agent: int = 5, actions: int = 30, least: int = 3) -> DataFrame:
    """What a narrative of each episode is made from, as one text: the users' prompts and the agent's thoughts in its range of
    prompts, by id, and its actions with their labels, by time. Episodes of fewer than ``least`` observations are left out."""
    by = ["session_id", "episode"]
    p = t.prompts.select(F.col("session_id").alias("_s"), F.col("id").alias("_id"), "source", F.col("content").alias("_text"))
    e = work_units.where(F.col("obs_count") >= least).select(*by, "first_prompt_id", "last_prompt_id")
    said = e.join(p, (e["session_id"] == p["_s"]) & p["_id"].between(e["first_prompt_id"], e["last_prompt_id"])).select(*by, "source", "_id", "_text")
    said = [_first(said.where(F.col("source") == x), by, ["_id"], n) for x, n in (("user", prompts), ("agent", agent))]
    said = said[0].unionByName(said[1]).groupBy(*by).agg(*[F.array_sort(F.collect_list(F.when(F.col("source") == x, F.struct("_id", "_text")))).alias(x) for x in ("user", "agent")])
    labels = F.concat_ws(",", "phase", "scope", "locus", "novelty")
    line = F.concat(F.lit("["), F.col("obs_type"), F.lit("] "), F.coalesce("file_path", F.substring("content", 1, 120)), F.when(labels != "", F.concat(F.lit(" ("), labels, F.lit(")"))).otherwise(""), F.when(failed(F.col("metadata")), " failed").otherwise(""))
    done = _first(members(e, t.observations).select(*by, "timestamp", "id", line.alias("line")), by, ["timestamp", "id"], actions)
    done = done.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "line"))).alias("actions"))
    of = lambda x: F.transform(F.coalesce(F.col(x), F.array().cast("array<struct<_id:bigint,_text:string>>")), lambda y: F.concat(F.lit(f"{x}: "), y["_text"]))
    text = F.array_join(F.concat(of("user"), of("agent"), F.transform("actions", lambda x: x["line"])), "\n")
    return done.join(said, by, "left").select(*by, text.alias("payload"))


def template_summary(payloads: DataFrame) -> DataFrame:
    """A deterministic stand-in for a language model's summary: the first prompt as intent, touched files, no lessons."""
    none = F.array().cast("array<string>")
    lines = F.split("payload", "\n")
    of = lambda kind: F.array_distinct(F.transform(F.filter(lines, lambda x: x.startswith(f"[{kind}] ")), lambda x: F.substring(x, len(kind) + 4, 1 << 20)))
    intent = F.coalesce(F.substring(F.get(F.filter(lines, lambda x: x.startswith("user: ")), F.lit(0)), 7, 200), F.lit("session without prompts"))
    summary = F.to_json(F.struct(intent.alias("intent"), none.alias("learned"), none.alias("completed"), none.alias("next_steps"), of("file_read").alias("files_read"), of("file_edit").alias("files_edited")))
    return payloads.select("session_id", summary.alias("summary"))


def lenient_summary(summary: Column) -> Column:
    """A summary whose lists may have been given as one text: as a struct of lists, empty if missing."""
    def field(name: str) -> Column:
        raw = F.get_json_object(summary, f"$.{name}")
        return F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).otherwise(F.array(raw))

    return F.struct(F.get_json_object(summary, "$.intent").alias("intent"), *[field(n).alias(n) for n in ("learned", "completed", "next_steps", "files_read", "files_edited")], F.get_json_object(summary, "$.notes").alias("notes"))


def catch_up(t: Tables, least: int = 3) -> DataFrame:
    """Ended sessions without a summary: which of them have enough observations for one."""
    n = t.observations.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    s = t.sessions.where(F.col("ended_at").isNotNull() & F.col("summary").isNull()).select("id", "project").join(n, "id", "left")
    return s.select("id", "project", F.coalesce("n", F.lit(0)).alias("obs_count"), F.when(F.coalesce("n", F.lit(0)) < least, "sentinel").otherwise("summarise").alias("action"))


SENTINEL = '{"intent":"empty session","learned":[],"completed":[],"next_steps":[],"files_read":[],"files_edited":[],"notes":null}'
