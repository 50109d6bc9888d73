"""Change history of files and structure of modules, from tables of commits, hunks, modules and uses."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.reliable import checkpoint, dealt
from tracelake.functions.scalar import failed, is_revert
from tracelake.model import Tables


def churn(commits: DataFrame) -> DataFrame:
    """For each file its commits, lines, reverts, and first and last change."""
    return commits.groupBy("file").agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count_if(is_revert(F.col("message"))).alias("reverts"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.countDistinct("author").alias("authors"))


def file_commits(commits: DataFrame, file: str, limit: int = 50) -> DataFrame:
    return commits.where(F.col("file") == file).orderBy(F.desc("timestamp"), "commit").limit(limit)


def co_changes(commits: DataFrame, file: str, limit: int = 10) -> DataFrame:
    """What changes together with a file most often, itself aside."""
    own = commits.where(F.col("file") == file).select("commit").distinct()
    return commits.where(F.col("file") != file).join(own, "commit", "left_semi").groupBy("file").agg(F.countDistinct("commit").alias("times")).orderBy(F.desc("times"), "file").limit(limit)


def dense_summary(churned: DataFrame) -> DataFrame:
    """A line for each file."""
    days = F.floor((F.col("last_ts") - F.col("first_ts")) / 86400)
    return churned.select("file", F.format_string("%d commits by %d authors over %d days, +%d/-%d, %d reverts", "commits", "authors", days, "insertions", "deletions", "reverts").alias("summary"))


def blame(hunks: DataFrame, lines: DataFrame, block: int = 64) -> DataFrame:
    """Each wanted line (``file, line``) with the first hunk (``file, start, count, commit``) that it is in, or none.

    Lines meet the hunks of their block of lines only, so that a long file's are dealt out; a hunk is in each block it reaches.
    """
    h = hunks.where("count > 0").select("file", "start", "count", "commit")
    n = h.count()
    # Of hunks of the same lines only that of the least commit can be the first.
    h = dealt(h, n, "file", "start").groupBy("file", "start", "count").agg(F.min(F.struct("commit")).alias("c"))
    h = h.select("file", F.struct("start", "count", "c.commit").alias("h"))
    h = h.select("file", "h", F.explode(F.sequence(F.floor(F.col("h.start") / block), F.floor((F.col("h.start") + F.col("h.count") - 1) / block))).alias("block"))
    at = lines.withColumn("block", F.floor(F.col("line") / block))
    found = dealt(at, n, "file", "block").join(dealt(h, n, "file", "block"), ["file", "block"]).where((F.col("h.start") <= F.col("line")) & (F.col("line") < F.col("h.start") + F.col("h.count")))
    found = found.groupBy("file", "block", "line").agg(F.min("h").alias("h")).drop("block")
    return lines.join(found, ["file", "line"], "left").select("file", "line", "h.commit", (F.col("line") - F.col("h.start")).alias("offset"))


def lines_of(hunks: DataFrame, after: int = 0) -> DataFrame:
    """``file, line``: the lines that any hunk (``file, start, count``) has, and so many after each."""
    h = hunks.where(F.col("count") + after > 0).select("file", "start", "count")
    h = dealt(h, h.count(), "file", "start").distinct()
    return h.select("file", F.explode(F.sequence("start", F.col("start") + F.col("count") + (after - 1))).alias("line")).distinct()


def resolve_uses(modules: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses with the module they mean: one of that name, else one of that last part of a path; others are dropped."""
    names = modules.select(F.col("module").alias("_name")).distinct()
    stem = lambda c: F.element_at(F.split(c, "/"), -1)
    stems = modules.groupBy(stem(F.col("module")).alias("_stem")).agg(F.max("module").alias("_by_stem"))
    u = uses.join(names, uses["uses"] == names["_name"], "left").join(stems, stem(F.col("uses")) == F.col("_stem"), "left")
    return u.select("module", F.coalesce("_name", "_by_stem").alias("target")).where(F.col("target").isNotNull())


def module_roles(modules: DataFrame, uses: DataFrame) -> DataFrame:
    """Degrees in the graph of uses, the role that follows from them, and lines for each public item."""
    e = resolve_uses(modules, uses)
    into = e.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("in_degree"))
    out = e.groupBy("module").agg(F.count("*").alias("out_degree"))
    m = modules.join(into, "module", "left").join(out, "module", "left").fillna(0, ["in_degree", "out_degree"])
    i, o = F.col("in_degree"), F.col("out_degree")
    role = (
        F.when((i == 0) & (o == 0), "isolated").when(i == 0, "leaf").when(o == 0, "foundation").when((i >= 5) & (o >= 5), "hub").when(o > i * 2, "orchestrator").when(i > o * 2, "foundation").otherwise("internal")
    )
    return m.withColumn("role", role).withColumn("lines_per_item", F.when(F.col("items") > 0, F.floor(F.col("lines") / F.col("items"))).otherwise(F.col("lines")))


def rankings(roles: DataFrame, limit: int = 15) -> DataFrame:
    """The top modules by uses of them, lines and items."""
    out = None
    for by in ("in_degree", "lines", "items"):
        one = roles.orderBy(F.desc(by), "module").limit(limit).select(F.lit(by).alias("ranking"), "module", F.col(by).cast("long").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def commit_order(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """``repo, commit, position``: each repository's commits (``repo, commit, timestamp``) from the newest on, no parent before a
    child of it (``repo, commit, parent``); of those that may come next the newest, at equal times the greatest id.

    Where all children are later than their parents, that is the order of time and ids. Only repositories in which a clock
    went wrong are walked, each in a task. Parents that aren't among the commits, as in a shallow copy, don't count. A circle
    of commits is an error.
    """
    c = commits.select("repo", "commit", "timestamp")
    old = c.select("repo", F.col("commit").alias("parent"), F.col("timestamp").alias("was"))
    edges = parents.select("repo", "commit", "parent").distinct().join(old, ["repo", "parent"]).join(c, ["repo", "commit"])
    wrong = checkpoint(edges.where(F.struct("timestamp", "commit") <= F.struct(F.col("was"), F.col("parent"))).select("repo").distinct())
    newest = Window.partitionBy("repo").orderBy(F.desc("timestamp"), F.desc("commit"))
    sorted_ = c.join(wrong, "repo", "left_anti").select("repo", "commit", F.row_number().over(newest).cast("long").alias("position"))
    if wrong.isEmpty():
        return sorted_
    links = edges.groupBy("repo", "commit").agg(F.collect_list("parent").alias("parents"))
    rows = c.join(wrong, "repo", "left_semi").join(links, ["repo", "commit"], "left")
    kind = {f.name: f.dataType.simpleString() for f in c.schema}
    return sorted_.unionByName(rows.groupBy("repo").applyInPandas(_walk, f"repo {kind['repo']}, commit {kind['commit']}, position long"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["timestamp", "commit"]).reset_index(drop=True)
    at = {c: i for i, c in enumerate(rows["commit"])}
    parents = [[at[p] for p in (x if x is not None else ())] for x in rows["parents"]]
    waiting = [0] * len(rows)  # children that haven't come yet
    for own in parents:
        for p in own:
            waiting[p] += 1
    ready, out = [-i for i, n in enumerate(waiting) if not n], []
    heapq.heapify(ready)
    while ready:
        out.append(i := -heapq.heappop(ready))
        for p in parents[i]:
            waiting[p] -= 1
            if not waiting[p]:
                heapq.heappush(ready, -p)
    if len(out) < len(rows):
        raise ValueError(f"the commits of {rows['repo'][0]} go in a circle")
    return pd.DataFrame({"repo": rows["repo"], "commit": rows["commit"].to_numpy()[out], "position": range(1, len(out) + 1)})


def first_parent_changes(trees: DataFrame, parents: DataFrame) -> DataFrame:
    """``repo, commit, path, change``: what each commit's files (``repo, commit, path, blob``) have added, modified or deleted against
    its first parent (``place`` 0 of ``repo, commit, parent, place``); the first commit, and one whose parent isn't there, has
    added all. Files whose content is the same aren't changes. A commit without files has deleted what its parent had."""
    first = parents.where("place = 0").select("repo", "commit", "parent")
    there = trees.select("repo", "commit", "path", F.col("blob").alias("new"))
    before = first.join(trees.select("repo", F.col("commit").alias("parent"), "path", F.col("blob").alias("old")), ["repo", "parent"]).drop("parent")
    both = there.join(before, ["repo", "commit", "path"], "full").where(~F.col("new").eqNullSafe(F.col("old")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return both.select("repo", "commit", "path", change.alias("change"))


def refined_file_history(t: Tables) -> DataFrame:
    """The last change of each file in each session, and whether the session had a failure before it."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, -1)
    o = t.observations.withColumn("failures_before", F.coalesce(F.sum(failed(F.col("metadata")).cast("int")).over(w), F.lit(0)).cast("long"))
    o = o.where(F.col("obs_type").isin("file_edit", "file_write") & F.col("file_path").isNotNull())
    last = Window.partitionBy("file_path", "session_id").orderBy(F.desc("timestamp"), F.desc("id"))
    touches = F.count("*").over(Window.partitionBy("file_path", "session_id"))
    return o.withColumn("touches", touches).withColumn("rn", F.row_number().over(last)).where("rn = 1").select("file_path", "session_id", "id", "timestamp", "touches", "failures_before")
