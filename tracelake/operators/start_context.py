"""What sessions start with, for any number of starts at once: the lists of ``context`` as of each start's own time.

A list's rows are numbered within their group in order of time, and a start knows how many came before it. So its newest rows are
those of the numbers that end there, found by an equal join: starts never meet all rows of their project. Numbers are counted
within blocks of time and added up over blocks, so that a project of a third of all rows is dealt out.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.reliable import checkpoint, dealt
from tracelake.functions.scalar import phase_label, relative_time
from tracelake.model import Tables
from tracelake.operators import context
from tracelake.operators.ranking import with_project

HOUR = 3600
#: Pins of other projects are numbered by how many came before, in blocks of so many.
PINS = 4096
HEADERS = ("## Recent Episodes", "## Earlier Sessions", "## Suggested Tasks", "## Recent Activity", "## Pinned Elsewhere")


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str, width: int = HOUR) -> DataFrame:
    """``rows`` with the number (``name``) of marks (``mark``) of the group ``by`` up to each row, by ``at``; at equal ``at`` what
    isn't a mark comes first, then marks in ``order``. No group and no ``at`` may be null."""
    b = rows.withColumn("block", F.floor(F.col("at") / width))
    along = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = b.groupBy(*by, "block").agg(F.count_if("mark").alias("c"))
    blocks = blocks.select(*by, "block", F.coalesce(F.sum("c").over(along), F.lit(0)).alias("before"))
    own = Window.partitionBy(*by, "block").orderBy("at", "mark", *order).rowsBetween(Window.unboundedPreceding, 0)
    return b.join(blocks, [*by, "block"]).withColumn(name, F.sum(F.col("mark").cast("long")).over(own) + F.col("before")).drop("block", "before")


def _both(marks: DataFrame, starts: DataFrame) -> DataFrame:
    return marks.withColumn("mark", F.lit(True)).unionByName(starts.withColumn("mark", F.lit(False)), allowMissingColumns=True)


def _last(n: Column, k: Column) -> Column:
    """The last ``k`` numbers up to ``n``, none if either is zero."""
    return F.explode(F.when((n > 0) & (k > 0), F.sequence(F.greatest(n - k + 1, F.lit(1)), n)))


def latest(marks: DataFrame, starts: DataFrame, order: list[Column | str], k: int | Column, by: tuple[str, ...] = ("project",)) -> DataFrame:
    """``s, i, m`` and all of ``by`` but the project: of each start (``by``, ``at, s``) the newest ``k`` rows (``by``, ``at, m`` and what
    ``order`` names) of before its time in its group, the newest with ``i`` 0."""
    p = checkpoint(numbered(_both(marks, starts), list(by), order, "n").select(*by, "mark", "s", "m", "n"))
    n = F.col("n")
    wanted = p.where(~F.col("mark")).select(*by, "s", n.alias("all"), _last(n, F.lit(k)).alias("n"))
    found = p.where("mark").select(*by, "n", "m")
    return wanted.join(found, [*by, "n"]).select("s", (F.col("all") - n).alias("i"), "m", *[c for c in by if c != "project"])


def latest_of_others(marks: DataFrame, starts: DataFrame, order: list[Column | str], k: int | Column) -> DataFrame:
    """``s, m``: the same of all other projects together.

    The r-th row that isn't of a project has, among all rows, the number r and as many more as the project has rows with fewer than
    r of others before them.
    """
    p = _both(marks, starts).withColumn("g", F.lit(0))
    p = checkpoint(numbered(numbered(p, ["g"], order, "all"), ["project"], order, "own").select("project", "mark", "s", "m", "all", "own"))
    others = F.col("all") - F.col("own")
    wanted = p.where(~F.col("mark")).select("project", "s", _last(others, F.lit(k)).alias("at"))
    own = p.where("mark").select("project", others.alias("at"))
    at = numbered(_both(own, wanted), ["project"], [], "j", PINS).where(~F.col("mark")).select("s", (F.col("at") + F.col("j")).alias("all"))
    return at.join(p.where("mark").select("all", "m"), "all").select("s", "m")


def _steps() -> Column:
    return F.posexplode(F.from_json("m.steps", "array<string>")).alias("at", "task")


def _part(rows: DataFrame, number: int, lines: Column) -> DataFrame:
    """``s, part, lines`` from an aggregate of each start's rows."""
    return rows.groupBy("s").agg(lines.alias("lines")).where(F.size("lines") > 0).select("s", F.lit(number).alias("part"), F.concat(F.array(F.lit(HEADERS[number])), "lines").alias("lines"))


def _in_order(key: Column, value: Column) -> Column:
    """An aggregate: values by their keys."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"])


def _of_kinds(starts: DataFrame, *kinds: str) -> DataFrame:
    return starts.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))


def _of_episodes(t: Tables, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of episodes, and next steps of the newest that have a summary."""
    own = t.sessions.select(F.col("id").alias("session_id"), "project", F.col("summary").alias("session_summary")).where("project IS NOT NULL")
    w = t.work_units.where("started_at IS NOT NULL").join(own, "session_id")
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("obs_count") > 0, "shown"), F.when(F.col("summary").isNotNull(), "steps"))))
    m = F.struct("started_at", context.episode_title().alias("title"), phase_label(F.col("phase_signature")).alias("label"), "obs_count", F.slice("hot_files", 1, 5).alias("hot_files"), context.learned().alias("learned"), F.get_json_object("summary", "$.next_steps").alias("steps"))
    marks = w.select("project", F.col("started_at").alias("at"), "session_id", "episode", m.alias("m"), kinds.alias("kind"))
    k = F.when(F.col("kind") == "shown", context.EPISODES).otherwise(context.TASKS)
    found = latest(marks, _of_kinds(starts, "shown", "steps"), [F.desc("session_id"), F.desc("episode")], k, ("kind", "project"))
    rows = found.where("kind = 'shown'").where(F.col("m.started_at") >= F.col("s.t") - F.col("s.hours") * HOUR).select("s", "i", "m.*")
    first = F.format_string("- %s [%s, %d actions]", F.coalesce("title", F.lit("?")), F.coalesce("label", F.lit("?")), "obs_count")
    more = lambda name, text: F.when((F.col("i") < 3) & (text != ""), F.concat(F.lit(f"  {name}: "), text))
    lines = F.array_compact(F.array(first, more("files", F.array_join("hot_files", ", ")), more("learned", F.col("learned"))))
    return _part(rows, 0, F.flatten(_in_order(F.col("i"), lines))), found.where("kind = 'steps'").select("s", F.lit(1).alias("source"), "i", _steps())


def _of_summaries(t: Tables, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of earlier sessions, and next steps of the newest summary."""
    sessions = t.sessions.where("summary IS NOT NULL AND project IS NOT NULL AND started_at IS NOT NULL")
    kind = F.lit("plain")
    if t.work_units is not None:
        sessions = sessions.join(t.work_units.select(F.col("session_id").alias("id"), F.lit(True).alias("has")).distinct(), "id", "left")
        kind = F.when(F.col("has"), "split").otherwise("plain")
    m = F.struct("started_at", "id", F.coalesce(F.get_json_object("summary", "$.intent"), F.lit("?")).alias("intent"), F.get_json_object("summary", "$.next_steps").alias("steps"))
    marks = sessions.select("project", F.col("started_at").alias("at"), "id", m.alias("m"), F.explode(F.array(F.lit("all"), kind)).alias("kind"))
    marks = checkpoint(dealt(marks, sessions.count(), "id"))
    # Sessions that have episodes are told when the window of episodes is over.
    probes = _of_kinds(starts, "all", "split", "plain").withColumn("at", F.col("at") - F.when(F.col("kind") == "split", F.col("s.hours") * HOUR).otherwise(0))
    found = latest(marks, probes, ["id"], F.when(F.col("kind") == "all", 1).otherwise(context.SUMMARIES), ("kind", "project"))
    newest = F.slice(F.sort_array(F.collect_list("m"), asc=False), 1, context.SUMMARIES)
    part = _part(found.where("kind <> 'all'"), 1, F.transform(newest, lambda x: F.concat(F.lit("- "), x["intent"])))
    return part, found.where("kind = 'all'").select("s", F.lit(0).alias("source"), "i", _steps())


def _tasks(steps: DataFrame) -> DataFrame:
    first = steps.groupBy("s", "task").agg(F.min(F.struct("source", "i", "at")).alias("first"))
    return _part(first, 2, F.slice(_in_order(F.col("first"), F.concat(F.lit("- "), F.col("task"))), 1, context.TASKS))


def _lines(rows: DataFrame, number: int) -> DataFrame:
    """Lines of activity: see ``context.activity_lines``, here for each start."""
    alone, title = context.stands_alone(), context.single_title()
    grouped = rows.where(~alone).groupBy("s", "file_path").agg(F.count("*").alias("n"), F.max("timestamp").alias("timestamp"))
    grouped = grouped.select("s", F.lit(0).alias("kind"), "timestamp", context.edits_title().alias("title"))
    both = grouped.unionByName(rows.where(alone).select("s", F.lit(1).alias("kind"), "timestamp", title.alias("title")))
    order = F.struct("kind", -F.col("timestamp"), "title")
    return _part(both, number, _in_order(order, context.activity_line(F.col("s.t"))))


def _activity(t: Tables, starts: DataFrame) -> list[DataFrame]:
    o = with_project(t.observations, t.sessions).where("project IS NOT NULL AND timestamp IS NOT NULL").withColumn("is_pinned", F.coalesce("is_pinned", F.lit(False)))
    kind = F.when(F.col("is_pinned"), "pin").when(F.col("obs_type") == "file_edit", "edit").when(F.col("obs_type").isin("git_commit", "git_push"), "git")
    # A title takes 60 characters of the content and needs to know whether there are more.
    m = F.struct("is_pinned", "timestamp", "id", "obs_type", "file_path", F.substring("content", 1, 61).alias("content"))
    marks = checkpoint(o.select("project", F.col("timestamp").alias("at"), "id", m.alias("m"), kind.alias("kind")).where("kind IS NOT NULL"))
    k, pins = F.col("s.local_limit"), marks.where("kind = 'pin'").drop("kind")
    told = checkpoint(latest(pins, starts, ["id"], k))
    # Pins come first, so a start that has as many as it may be told is told nothing else.
    full = told.where(F.col("i") == k - 1).select("s")
    rest = checkpoint(starts.join(full, "s", "left_anti"))
    rows = latest(marks.where("kind <> 'pin'"), _of_kinds(rest, "edit", "git"), ["id"], k, ("kind", "project"))
    hours = F.when(F.col("kind") == "edit", 2).otherwise(24)
    rows = told.select("s", "m").unionByName(rows.where(F.col("m.timestamp") > F.col("s.t") - hours * HOUR).select("s", "m"))
    # At most three times the limit for each start.
    first = rows.groupBy("s").agg(F.sort_array(F.collect_list("m"), asc=False).alias("m"))
    local = first.select("s", F.inline(F.slice("m", F.lit(1), k.cast("int"))))
    elsewhere = latest_of_others(pins, starts, ["id"], F.col("s.cross_limit")).select("s", "m.*")
    return [_lines(local, 3), _lines(elsewhere, 4)]


def at_starts(t: Tables, starts: DataFrame) -> DataFrame:
    """``session_id, project, t, context``: the Markdown that each start gets, from what there was before it, as ``context.render``
    gives it for a single one.

    ``starts``: ``session_id, project, t`` (seconds), and if wanted ``recovery``, ``local_limit``, ``cross_limit``, ``hours`` (nulls:
    the usual). Equal starts are one; one without project or time, or with nothing to tell but tasks, has no row.
    """
    have = lambda name, other: F.coalesce(F.col(name), other) if name in starts.columns else other
    recovery = have("recovery", F.lit(False))
    usual = lambda i: F.when(recovery, context.RECOVERY_LIMITS[i]).otherwise(context.LIMITS[i])
    s = starts.where("project IS NOT NULL AND t IS NOT NULL").select(
        "session_id", "project", F.col("t").cast("long").alias("t"), have("local_limit", usual(0)).cast("long").alias("local_limit"), have("cross_limit", usual(1)).cast("long").alias("cross_limit"), have("hours", F.lit(context.WINDOW_HOURS)).cast("long").alias("hours")
    )
    # All parts read the starts, and two of them the episodes, several times: they are made once, the starts in as many partitions
    # as they need, not those of the sessions' table, each of which would be dealt out anew by every part.
    s = checkpoint(dealt(s, s.count(), "session_id").distinct().select("project", F.col("t").alias("at"), F.struct("session_id", "project", "t", "local_limit", "cross_limit", "hours").alias("s")))
    if t.work_units is not None:
        t = replace(t, work_units=checkpoint(t.work_units))
    earlier, steps = _of_summaries(t, s)
    parts = [earlier, *_activity(t, s)]
    if t.work_units is not None:
        shown, more = _of_episodes(t, s)
        parts, steps = [*parts, shown], steps.unionByName(more)
    parts.append(_tasks(steps))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows = rows.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("part", "lines"))).alias("parts")).where(F.exists("parts", lambda x: x["part"] != 2))
    text = F.array_join(F.flatten(F.transform("parts", lambda x: x["lines"])), "\n")
    return rows.select("s.session_id", "s.project", "s.t", F.concat(text, F.lit("\n")).alias("context"))
