"""The activity model over the driver's parquet tables, for Spark, and as the WITH clause of the queries' SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.reliable import dealt
from tracelake.model import Tables

EPOCH = 1_704_067_200  # 2024-01-01


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions of weekly sessions, and one action for each prompt of a conversation."""
    e = read(spark, sf_dir, "events")
    e = e.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "user_id", "event_type", "value", F.regexp_extract("props", r'"k": ?([0-9]+)', 1).cast("long").alias("k"))
    kind = F.when(F.col("event_type") == "click", "file_read").when(F.col("event_type") == "view", "search").when(F.col("event_type") == "purchase", "file_edit").otherwise("command")
    e = e.withColumn("obs_type", kind).withColumn("kk", F.when((F.col("obs_type") == "file_edit") & (F.col("k") % 4 == 0), F.col("k") + 1).otherwise(F.col("k")))
    path = F.when(F.col("obs_type") != "command", F.concat(F.lit("/src/m"), (F.col("kk") % 10).cast("string"), F.lit("/f"), F.col("kk").cast("string"), F.lit(".rs")))
    k = F.col("k").cast("string")
    command = F.when(F.col("k") % 5 == 0, F.concat(F.lit("cargo test t"), k, F.lit(" 2>&1"))).when(F.col("k") % 5 == 1, "npm run build").when(F.col("k") % 5 == 2, F.concat(F.lit("ls -la /tmp/"), (F.col("k") % 3).cast("string"))).when(F.col("k") % 5 == 3, F.concat(F.lit("which x"), k)).otherwise("~/.cargo/bin/cargo build")
    error = F.concat(F.lit('{"failed":true,"response":"error: code '), (F.col("k") % 20).cast("string"), F.lit('"}'))
    labelled = F.col("k") % 11 != 0
    first = e.select(
        F.col("event_id").alias("id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-w"), F.floor((F.col("t") - EPOCH) / 604800).cast("string")).alias("session_id"),
        F.lit(None).cast("long").alias("prompt_id"),
        F.col("t").alias("timestamp"),
        "obs_type",
        F.lit("PostToolUse").alias("source_event"),
        F.col("event_type").alias("tool_name"),
        path.alias("file_path"),
        F.coalesce(path, command).alias("content"),
        F.when(F.col("event_type") == "error", error).alias("metadata"),
        (F.col("event_id") % 97 == 0).alias("is_pinned"),
        F.when(labelled, F.when(F.col("obs_type").isin("file_edit", "command"), "act").otherwise("think")).alias("phase"),
        F.when(labelled, F.when(F.col("value") >= 100, "converge").otherwise("diverge")).alias("scope"),
        F.when(F.col("k") % 7 != 0, F.when(F.col("k") % 3 == 0, "external").otherwise("internal")).alias("locus"),
        F.when(F.col("k") % 5 == 0, "novel").otherwise("routine").alias("novelty"),
        F.when(labelled, F.when(F.col("event_type") == "error", "friction").otherwise("smooth")).alias("friction"),
    )
    p = prompts(spark, sf_dir)
    turn = F.col("id") % 1000
    conv = F.floor(F.col("id") / 1000)
    kind = F.when(turn % 4 == 0, "file_read").when(turn % 4 == 1, "file_edit").when(turn % 4 == 2, "command").otherwise("search")
    path = F.when(turn % 4 < 2, F.concat(F.lit("/src/c"), (conv % 7).cast("string"), F.lit("/p"), (turn % 3).cast("string"), F.lit(".rs")))
    second = p.select(
        (F.col("id") + 10_000_000_000).alias("id"),
        "session_id",
        F.col("id").alias("prompt_id"),
        (F.col("timestamp") + 3).alias("timestamp"),
        kind.alias("obs_type"),
        F.lit("PostToolUse").alias("source_event"),
        F.lit("tool").alias("tool_name"),
        path.alias("file_path"),
        F.coalesce(path, F.lit("cargo build")).alias("content"),
        F.when((kind == "command") & (conv % 5 == 0), F.lit('{"failed":true,"response":"exit code 2"}')).alias("metadata"),
        F.lit(False).alias("is_pinned"),
        F.when(turn % 2 == 0, F.when(turn % 4 == 0, "think").otherwise("act")).alias("phase"),
        F.when(conv % 2 == 0, "converge").alias("scope"),
        F.lit("internal").alias("locus"),
        F.lit("routine").alias("novelty"),
        F.lit(None).cast("string").alias("friction"),
    )
    return first.unionByName(second)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users and assistants as prompts, in sessions of a conversation each."""
    c = read(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        (F.lit(EPOCH) + F.col("conv_id") * 1000 + F.col("turn") * 10).alias("timestamp"),
        F.when(F.col("role") == "user", "user").otherwise("agent").alias("source"),
        F.substring("text", 1, 2000).alias("content"),
    )


def sessions(obs: DataFrame) -> DataFrame:
    """From the observations' spans; a third without a summary."""
    s = obs.groupBy(F.col("session_id").alias("id")).agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"))
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    part = lambda m: (n % m).cast("string")
    summary = F.concat(F.lit('{"intent":"repair the login flow of module m'), part(5), F.lit(' and its tests","learned":["lesson '), part(4), F.lit('"],"completed":[],"next_steps":["step '), part(5), F.lit('","step '), part(3), F.lit('"],"files_read":[],"files_edited":[],"notes":null}'))
    return s.select("id", F.concat(F.lit("p"), part(7)).alias("project"), "started_at", "ended_at", F.when(n % 3 != 0, summary).alias("summary"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits that touch parts."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    # Lines and orders meet by order in partitions that don't grow; lines are grouped where they meet.
    n = li.count()
    o, li = dealt(o, n, "o_orderkey"), dealt(li, n, "l_orderkey")
    li = li.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("insertions"), F.sum(F.col("l_linenumber")).cast("long").alias("deletions"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_orderkey").cast("string").alias("commit"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("file"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 10).cast("string")).alias("author"),
        F.when(F.col("o_orderkey") % 13 == 0, "Revert it").when(F.col("o_orderkey") % 17 == 0, "do a rollback").otherwise(F.concat(F.lit("change "), F.col("o_orderkey").cast("string"))).alias("message"),
        "insertions",
        "deletions",
    )


def repositories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, parents, trees): each customer is a repository, orders are its commits and their lines its files. A commit's
    first parent is the customer's order before it; every fifth key also has the one before that as a second parent."""
    c = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"))
    along = Window.partitionBy("repo").orderBy("timestamp", "commit")
    p = c.select("repo", "commit", F.lag("commit").over(along).alias("first"), F.when(F.col("commit") % 5 == 0, F.lag("commit", 2).over(along)).alias("second"))
    p = p.select("repo", "commit", F.posexplode(F.array("first", "second")).alias("place", "parent")).where("parent IS NOT NULL")
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("commit"), (F.col("l_partkey") % 5).alias("path")).agg(F.max(F.col("l_suppkey") % 3).alias("blob"))
    return c, p, li.join(c.select("repo", "commit"), "commit").select("repo", "commit", "path", "blob")


def module_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(modules ``module, lines, items``, uses ``module, uses``): brands of parts and what is ordered with them."""
    p = read(spark, sf_dir, "part")
    modules = p.groupBy(F.concat(F.lit("m"), (F.col("p_partkey") % 40).cast("string")).alias("module")).agg(F.sum("p_size").cast("long").alias("lines"), F.count("*").alias("items"))
    # Module n uses at most n % 11 others, so that all roles are there.
    li, n = read(spark, sf_dir, "lineitem"), F.col("l_partkey") % 37
    uses = li.select(F.concat(F.lit("m"), n.cast("string")).alias("module"), F.concat(F.lit("dir/m"), (F.col("l_suppkey") % F.greatest(n % 11, F.lit(1)) * 4 + 2).cast("string")).alias("uses")).distinct()
    return modules, uses


#: The model of each folder that this process has loaded, by application; its tables stay cached, on disk where memory is short.
_LOADED: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The model, made once for all queries of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        obs = observations(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        _LOADED[key] = Tables(sessions=sessions(obs).persist(StorageLevel.MEMORY_AND_DISK), prompts=prompts(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK), observations=obs)
    return _LOADED[key]


def as_of(obs: DataFrame) -> int:
    """One second past the newest row: the engine has no hidden clock."""
    return (obs.agg(F.max("timestamp")).first()[0] or 0) + 1


#: The same tables in DuckDB; each query's SQL goes on after it.
SQL = r"""
WITH RECURSIVE ev AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id, event_type, value, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS k FROM events),
ev1 AS (SELECT *, CASE event_type WHEN 'click' THEN 'file_read' WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'file_edit' ELSE 'command' END AS obs_type FROM ev),
ev2 AS (SELECT *, CASE WHEN obs_type = 'file_edit' AND k % 4 = 0 THEN k + 1 ELSE k END AS kk FROM ev1),
ev3 AS (SELECT *, CASE WHEN obs_type <> 'command' THEN '/src/m' || (kk % 10) || '/f' || kk || '.rs' END AS path FROM ev2),
prompts AS (SELECT conv_id * 1000 + turn AS id, 'c' || conv_id AS session_id, 1704067200 + conv_id * 1000 + turn * 10 AS timestamp, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS source, substr(text, 1, 2000) AS content FROM conversations WHERE role IN ('user', 'assistant')),
pr AS (SELECT *, id % 1000 AS turn, id // 1000 AS conv FROM prompts),
pr1 AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'file_read' WHEN 1 THEN 'file_edit' WHEN 2 THEN 'command' ELSE 'search' END AS obs_type, CASE WHEN turn % 4 < 2 THEN '/src/c' || (conv % 7) || '/p' || (turn % 3) || '.rs' END AS path FROM pr),
obs AS (
  SELECT event_id AS id, user_id || '-w' || CAST(floor((t - 1704067200) / 604800) AS BIGINT) AS session_id, CAST(NULL AS BIGINT) AS prompt_id, t AS timestamp, obs_type, event_type AS tool_name, path AS file_path,
         coalesce(path, CASE k % 5 WHEN 0 THEN 'cargo test t' || k || ' 2>&1' WHEN 1 THEN 'npm run build' WHEN 2 THEN 'ls -la /tmp/' || (k % 3) WHEN 3 THEN 'which x' || k ELSE '~/.cargo/bin/cargo build' END) AS content,
         CASE WHEN event_type = 'error' THEN '{"failed":true,"response":"error: code ' || (k % 20) || '"}' END AS metadata,
         event_type = 'error' AS failed, CASE WHEN event_type = 'error' THEN 'error: code ' || (k % 20) END AS response, event_id % 97 = 0 AS is_pinned,
         CASE WHEN k % 11 <> 0 THEN CASE WHEN obs_type IN ('file_edit', 'command') THEN 'act' ELSE 'think' END END AS phase,
         CASE WHEN k % 11 <> 0 THEN CASE WHEN value >= 100 THEN 'converge' ELSE 'diverge' END END AS scope,
         CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 3 = 0 THEN 'external' ELSE 'internal' END END AS locus,
         CASE WHEN k % 5 = 0 THEN 'novel' ELSE 'routine' END AS novelty,
         CASE WHEN k % 11 <> 0 THEN CASE WHEN event_type = 'error' THEN 'friction' ELSE 'smooth' END END AS friction
  FROM ev3
  UNION ALL
  SELECT id + 10000000000, session_id, id, timestamp + 3, obs_type, 'tool', path, coalesce(path, 'cargo build'),
         CASE WHEN obs_type = 'command' AND conv % 5 = 0 THEN '{"failed":true,"response":"exit code 2"}' END,
         obs_type = 'command' AND conv % 5 = 0, CASE WHEN obs_type = 'command' AND conv % 5 = 0 THEN 'exit code 2' END, false,
         CASE WHEN turn % 2 = 0 THEN CASE WHEN turn % 4 = 0 THEN 'think' ELSE 'act' END END, CASE WHEN conv % 2 = 0 THEN 'converge' END, 'internal', 'routine', NULL
  FROM pr1),
now AS (SELECT max(timestamp) + 1 AS t FROM obs),
ses0 AS (SELECT session_id AS id, min(timestamp) AS started_at, max(timestamp) AS ended_at, CAST(regexp_extract(session_id, '([0-9]+)', 1) AS BIGINT) AS n FROM obs GROUP BY session_id),
ses AS (SELECT id, 'p' || (n % 7) AS project, started_at, ended_at, n,
        CASE WHEN n % 3 <> 0 THEN 'repair the login flow of module m' || (n % 5) || ' and its tests' END AS intent,
        CASE WHEN n % 3 <> 0 THEN ['step ' || (n % 5), 'step ' || (n % 3)] END AS next_steps FROM ses0)
"""
