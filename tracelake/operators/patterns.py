"""Patterns across sessions: failed commands, unresolved reads, recurring errors, repeated intents, stuck loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.reliable import checkpoint
from tracelake.functions.scalar import error_signature, exp_decay, failed, intent_keywords, is_diagnostic, is_reference_path, normalize_command, short_intent
from tracelake.model import Tables

THRESHOLD, HALF_LIFE_HOURS, TOP = 3, 168.0, 20


def grouped(df: DataFrame, kind: str, key: str, example: str, *, as_of: int, threshold: int, half_life: float, top: int = TOP) -> DataFrame:
    """Sessions by pattern: how many, how hot (each session's newest time decays), and which. Two partial aggregations."""
    each = checkpoint(df.groupBy(F.col(key).alias("pattern"), "session_id").agg(F.max("timestamp").alias("t"), F.min(example).alias("example")))
    heat = F.sum(exp_decay((F.lit(as_of) - F.col("t")) / 3600.0, half_life))
    g = each.groupBy("pattern").agg(F.count("*").alias("session_count"), F.round(heat, 6).alias("heat"), F.min("example").alias("example"))
    g = checkpoint(g.where(F.col("session_count") >= threshold).orderBy(F.desc("heat"), "pattern").limit(top))
    # Only the sessions of the few patterns that stay are gathered.
    of = each.join(F.broadcast(g.select("pattern")), "pattern").groupBy("pattern").agg(F.array_sort(F.collect_set("session_id")).alias("sessions"))
    return g.join(of, "pattern").select(F.lit(kind).alias("kind"), "pattern", "session_count", "heat", "sessions", F.substring("example", 1, 200).alias("example")).orderBy(F.desc("heat"), "pattern")


def failed_commands(t: Tables, *, as_of: int, threshold: int = THRESHOLD, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    """Commands that failed in several sessions, alike but for arguments and folders; probes don't count."""
    o = t.observations.where((F.col("obs_type") == "command") & failed(F.col("metadata"))).where(~is_diagnostic(F.col("content")))
    return grouped(o.withColumn("key", normalize_command(F.col("content"))), "failed_command", "key", "content", as_of=as_of, threshold=threshold, half_life=half_life)


def unresolved_reads(t: Tables, *, as_of: int, threshold: int = THRESHOLD, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    """Files that several sessions read and none ever changed, reference material aside."""
    read = t.observations.where((F.col("obs_type") == "file_read") & F.col("file_path").isNotNull())
    changed = t.observations.where(F.col("obs_type").isin("file_edit", "file_write")).select("file_path").distinct()
    read = read.where(~is_reference_path(F.col("file_path"))).join(changed, "file_path", "left_anti")
    return grouped(read, "unresolved_read", "file_path", "file_path", as_of=as_of, threshold=threshold, half_life=half_life)


def recurring_errors(t: Tables, *, as_of: int, threshold: int = THRESHOLD, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    o = t.observations.where((F.col("obs_type") == "command") & failed(F.col("metadata"))).withColumn("response", F.get_json_object("metadata", "$.response")).where(F.col("response").isNotNull())
    o = o.withColumn("key", error_signature(F.col("response"))).where("key != ''")
    return grouped(o, "recurring_error", "key", "response", as_of=as_of, threshold=threshold, half_life=half_life)


#: Of repeated intents: the least similarity of an intent to its seed's, as a fraction.
ALIKE, OUT_OF = 4, 10


def _alike(bags: DataFrame) -> DataFrame:
    """``early, late``: pairs of bags (``bag, first, words``) with a Jaccard similarity of ALIKE/OUT_OF or more, the one that comes first
    as ``early``.

    Such bags share one of their first words, rare before frequent, so only bags that do are compared.
    """
    words = bags.select("bag", F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    in_order = words.join(often, "word").groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("w"))
    n = F.size("w")
    first = F.slice("w", F.lit(1), (n - F.ceil(n * ALIKE / OUT_OF) + 1).cast("int"))
    prefix = in_order.select("bag", F.explode(first).alias("w")).select("bag", "w.word")
    pairs = prefix.alias("x").join(prefix.alias("y"), (F.col("x.word") == F.col("y.word")) & (F.col("x.bag") < F.col("y.bag"))).select(F.col("x.bag").alias("a"), F.col("y.bag").alias("b")).distinct()
    x, y = (bags.select(F.col("bag").alias(k), F.col("first").alias(f"first_{k}"), F.col("words").alias(f"words_{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b")
    both = both.where(F.size(F.array_intersect("words_a", "words_b")) * OUT_OF >= F.size(F.array_union("words_a", "words_b")) * ALIKE)
    later = F.col("first_a") > F.col("first_b")
    return both.select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("early"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("late"), F.when(later, F.col("first_b")).otherwise(F.col("first_a")).alias("first"))


def _seeds(bags: DataFrame) -> DataFrame:
    """``bag, seed``: greedy clusters in order of ``first``, in which a seed takes all later bags that are like it and free.

    In rounds: of those that a bag is like, the earliest that isn't known to be taken decides. If it is a seed, it takes the
    bag; if there is none, the bag is a seed; else the bag waits. The earliest bag that waits is settled in each round.
    """
    edges = checkpoint(_alike(bags))
    settled, waiting = None, checkpoint(bags.select("bag"))
    while not waiting.isEmpty():
        known = waiting.select("bag", F.lit(None).cast("string").alias("seed"))
        known = known if settled is None else known.unionByName(settled)
        open_ = known.where(F.col("seed").isNull() | (F.col("seed") == F.col("bag"))).select(F.col("bag").alias("early"), F.col("seed").isNotNull().alias("is_seed"))
        first = edges.join(open_, "early").groupBy(F.col("late").alias("bag")).agg(F.min(F.struct("first", "early", "is_seed")).alias("x"))
        now = checkpoint(waiting.join(first, "bag", "left").select("bag", F.when(F.col("x").isNull(), F.col("bag")).when(F.col("x.is_seed"), F.col("x.early")).alias("seed")))
        done = now.where("seed IS NOT NULL")
        settled = done if settled is None else settled.unionByName(done)
        waiting = now.where("seed IS NULL").select("bag")
    return settled if settled is not None else bags.select("bag", F.lit(None).cast("string").alias("seed"))


def repeated_intents(t: Tables, *, as_of: int, threshold: int = THRESHOLD, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    """Sessions of like intents (Jaccard of keywords with a seed's of 0.4 or more).

    Equal keyword sets are one before they are clustered. Order is by first start and id; the newest intent stands for its group.
    """
    s = t.sessions.withColumn("intent", F.get_json_object("summary", "$.intent")).where(F.col("intent").isNotNull())
    s = s.select("id", "started_at", "intent", F.array_sort(F.array_distinct(intent_keywords(F.col("intent")))).alias("words"))
    # No keywords: such intents are like none, each is a cluster of its own.
    s = s.withColumn("bag", F.array_join("words", " ")).where("bag != ''")
    bags = checkpoint(s.groupBy("bag").agg(F.min(F.struct("started_at", "id")).alias("first"), F.first("words").alias("words")))
    s = checkpoint(s.join(_seeds(bags), "bag").select("seed", "id", "started_at", "intent"))
    heat = F.sum(exp_decay((F.lit(as_of) - F.col("started_at")) / 3600.0, half_life))
    g = s.groupBy("seed").agg(F.count("*").alias("session_count"), F.round(heat, 6).alias("heat"), F.max_by("intent", F.struct("started_at", "id")).alias("example"))
    g = g.where(F.col("session_count") >= threshold).withColumn("pattern", short_intent(F.col("example")))
    g = checkpoint(g.orderBy(F.desc("heat"), "pattern").limit(TOP))
    # Only the sessions of the few clusters that stay are gathered.
    of = s.join(F.broadcast(g.select("seed")), "seed").groupBy("seed").agg(F.array_sort(F.collect_set("id")).alias("sessions"))
    return g.join(of, "seed").select(F.lit("repeated_intent").alias("kind"), "pattern", "session_count", "heat", "sessions", "example").orderBy(F.desc("heat"), "pattern")


def normalised(patterns: DataFrame) -> DataFrame:
    """Heat as whole hundredths of the hottest of all kinds (at most 80 rows, so one window is fine)."""
    top = F.max("heat").over(Window.partitionBy())
    return patterns.withColumn("heat", F.when(top > 0, F.round(F.col("heat") / top * 100)).otherwise(F.col("heat")))


def all_patterns(t: Tables, *, as_of: int, threshold: int = THRESHOLD, half_life: float = HALF_LIFE_HOURS, intents: bool = True) -> DataFrame:
    kinds = [failed_commands, unresolved_reads, recurring_errors] + [repeated_intents] * intents
    out = None
    for f in kinds:
        one = f(t, as_of=as_of, threshold=threshold, half_life=half_life)
        out = one if out is None else out.unionByName(one)
    return normalised(out)


def stuck_loops(intents: DataFrame, evidence: DataFrame, shared: int = 2) -> DataFrame:
    """Repeated intents that share two or more sessions with a failure or error: by sessions, not by pairs of patterns."""
    i = intents.select(F.col("pattern").alias("intent"), F.explode("sessions").alias("session_id"))
    e = evidence.where(F.col("kind").isin("failed_command", "recurring_error")).select("kind", "pattern", F.explode("sessions").alias("session_id"))
    return i.join(e, "session_id").groupBy("intent", "kind", "pattern").agg(F.count("*").alias("shared_sessions")).where(F.col("shared_sessions") >= shared)


def like(term: str, *cols: str) -> Column:
    """Whether any column contains the term, ASCII letters in either case; % and _ stand for themselves."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.lit(False)
    for c in cols:
        found = found | F.coalesce(F.contains(fold(F.col(c)), fold(F.lit(term))), F.lit(False))
    return found
