"""What results are written as: JSON lines, id lists, logs by partition of day, metrics, module maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text (``value``); null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def id_list(df: DataFrame, column: str = "id") -> DataFrame:
    """One row: the ids, comma-joined in order. For the top rows of a search."""
    return df.agg(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ",").alias("ids"))


def log_records(obs: DataFrame) -> DataFrame:
    """Flat records of observations, git fields beside the others, for a log stream."""
    detail = lambda x: F.get_json_object("metadata", f"$.{x}").alias(x)
    message = F.concat(F.lit("["), F.col("obs_type"), F.lit("] "), F.substring(F.coalesce("file_path", "content"), 1, 80))
    return obs.select("timestamp", "session_id", "obs_type", "tool_name", "file_path", message.alias("message"), "phase", "scope", "locus", "novelty", *[detail(x) for x in ("branch", "commit_hash", "commit_message", "files_changed", "insertions", "deletions")])


def write_logs(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines by day: each task writes its own, nothing is gathered."""
    records.withColumn("day", F.to_date(F.timestamp_seconds("timestamp"))).write.mode("append").partitionBy("day").json(path)


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """A Parquet table, by day or another column if given, so that later scans skip what they don't need."""
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).parquet(path)


def counters(obs: DataFrame) -> DataFrame:
    """Totals for metrics: observations by type and event; a commit counts as one, not as a command."""
    return obs.groupBy("obs_type", F.coalesce("source_event", F.lit("none")).alias("source_event")).agg(F.count("*").alias("total"))


def module_map(roles: DataFrame) -> str:
    """The structure of modules as TOML, by name (as many rows as there are source files)."""
    out = []
    for r in roles.orderBy("module").collect():
        out += [f'[modules."{r.module}"]', f"lines = {r.lines}", f"in_degree = {r.in_degree}", f"out_degree = {r.out_degree}", f'role = "{r.role}"', f"lines_per_pub_item = {r.lines_per_item}", ""]
    return "\n".join(out)


def _quoted(x: Column) -> Column:
    """A text as a basic string of TOML; characters that it can't hold are left out."""
    safe = F.replace(F.replace(F.regexp_replace(x, "[\\x00-\\x1F\\x7F]", ""), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), safe, F.lit('"'))


def _list(xs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(xs, F.array().cast("array<string>")), _quoted), ", "), F.lit("]"))


def _toml(*lines: Column | tuple[str, Column]) -> Column:
    return F.concat(*[F.concat(x if isinstance(x, Column) else F.concat(F.lit(f"{x[0]} = "), x[1].cast("string")), F.lit("\n")) for x in lines])


def module_files(modules: DataFrame, uses: DataFrame) -> DataFrame:
    """``file, text``: a TOML file for each module (``module, path, lines, functions, types``; uses: ``module, uses``), made in the
    tasks. A slash in a name becomes two dashes in the file's; equal uses count once, in order."""
    u = uses.groupBy("module").agg(F.array_sort(F.collect_set("uses")).alias("deps"))
    m = modules.join(u, "module", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    item = lambda kind: lambda x: F.concat(F.lit("\n[[items]]\nname = "), _quoted(x), F.lit(f'\nkind = "{kind}"\n'))
    items = F.array_join(F.concat(F.transform("functions", item("function")), F.transform("types", item("type"))), "")
    text = _toml(
        F.lit("[module]"), ("name", _quoted(F.col("module"))), ("path", _quoted(F.col("path"))), ("lines", F.col("lines")),
        F.lit("\n[coordination]"), ("deps", _list(F.col("deps"))),
        F.lit("\n[control]"), ("lines", F.col("lines")), ("dep_count", F.size("deps")),
        F.lit("\n[policy]"), ("pub_fns", _list(F.col("functions"))), ("pub_types", _list(F.col("types"))),
    )
    return m.select(F.concat(F.replace("module", F.lit("/"), F.lit("--")), F.lit(".toml")).alias("file"), F.concat(text, items).alias("text"))


def project_map(modules: DataFrame, uses: DataFrame, project: str, scanned_at: int, git_hash: str | None = None) -> str:
    """All modules of a project as one TOML text: as many tables as it has source files."""
    u = uses.groupBy("module").agg(F.array_sort(F.collect_set("uses")).alias("deps"))
    one = _toml(F.concat(F.lit("\n[modules."), _quoted(F.col("module")), F.lit("]")), ("path", _quoted(F.col("path"))), ("lines", F.col("lines")), ("deps", _list(F.col("deps"))), ("pub_items", _list(F.concat("functions", "types"))))
    rows = modules.join(u, "module", "left").select("module", "lines", one.alias("text")).orderBy("module").collect()
    name, commit = modules.sparkSession.range(1).select(_quoted(F.lit(project)), _quoted(F.lit(git_hash or ""))).first()
    head = ["[project]", f"name = {name}", *([f"git_hash = {commit}"] if git_hash else []), f"scanned_at = {scanned_at}", f"module_count = {len(rows)}", f"total_lines = {sum(r.lines for r in rows)}"]
    return "\n".join(head) + "\n" + "".join(r.text for r in rows)


def graph_map(roles: DataFrame, rankings: DataFrame) -> str:
    """What the graph of modules says, as TOML: its size, which modules others stand on and which nothing uses, rankings, and
    ``module_map``. From ``code_history.module_roles`` and ``rankings``."""
    base = (F.col("out_degree") == 0) & (F.col("in_degree") > 0)
    named = lambda which: _list(F.array_sort(F.collect_list(F.when(which, F.col("module")))))
    g = roles.agg(F.count("*").alias("n"), F.coalesce(F.sum("in_degree"), F.lit(0)).alias("edges"), named(base).alias("foundation"), named(F.col("in_degree") == 0).alias("leaf")).first()
    first = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "module")))
    order = {r.ranking: r.names for r in rankings.groupBy("ranking").agg(_list(F.transform(first, lambda x: x["module"])).alias("names")).collect()}
    out = ["[graph]", f"total_modules = {g.n}", f"total_edges = {g.edges}", f"foundation = {g.foundation}", f"leaf = {g.leaf}", "", "[ranking]"]
    out += [f"{name} = {order.get(by, '[]')}" for name, by in (("by_in_degree", "in_degree"), ("by_lines", "lines"), ("by_api_surface", "items"))]
    return "\n".join(out) + "\n\n" + module_map(roles)


#: Upper bounds, in seconds, of a histogram of durations.
BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0)


def buckets_of(seconds: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """An aggregate: for each bound how many are at most that, then how many there are."""
    return F.array(*[F.count_if(seconds <= b) for b in bounds], F.count(seconds))


def histogram(rows: DataFrame, kind: str, seconds: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """``kind, count, sum, buckets`` of durations: each bucket counts what is at most its bound, the last all."""
    return rows.groupBy(kind).agg(F.count(seconds).alias("count"), F.round(F.sum(seconds), 6).alias("sum"), buckets_of(F.col(seconds), bounds).alias("buckets"))
