"""The stream side: events in, deduplicated tables and windowed rates out. Batches reuse the functions of ``sources.hooks``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.model import HOOKS, Tables
from tracelake.sources import hooks

EVENTS = f"{HOOKS}, event_time timestamp"


def source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events from JSON files as they arrive; ``event_time`` is part of each event."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(events: DataFrame, out: str, checkpoint: str, settings: hooks.Settings | None = None, contexts: bool = False):
    """Appends prompts and observations to tables. Ids are hashes of their events, so a batch that is done again is told
    apart: within the watermark equal events are one, and a batch's files are replaced under its own number. With ``contexts``
    each start of a session also gets its context, out of what had been ingested and its own batch."""
    s = settings or hooks.Settings()
    seen = events.withWatermark("event_time", "1 hour").dropDuplicatesWithinWatermark(["session_id", "event_time", "hook_event_name", "tool_name", "tool_input", "prompt"])

    def write(batch: DataFrame, number: int) -> None:
        e = hooks.stamped(batch, "event_time")
        for name, df in (("prompts", hooks.prompts(e, s)), ("observations", hooks.observations(e, s)), ("sessions", hooks.sessions(e, s))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        if contexts:
            told = hooks.start_contexts(batch, "event_time", tables(batch.sparkSession, out), s)
            told.write.mode("overwrite").parquet(f"{out}/contexts/batch={number}")

    return seen.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def tables(spark: SparkSession, out: str) -> Tables:
    """What has been ingested so far: sessions merged over batches, observations linked to prompts, ended sessions closed."""
    from tracelake.operators.ranking import link_prompts

    s = spark.read.parquet(f"{out}/sessions").groupBy("id").agg(F.min_by("project", "started_at").alias("project"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))
    p = spark.read.parquet(f"{out}/prompts").drop("batch").dropDuplicates(["id"])
    o = spark.read.parquet(f"{out}/observations").drop("batch").dropDuplicates(["id"])
    return hooks.close(Tables(sessions=s, prompts=p, observations=link_prompts(o, p)))


def rate(events: DataFrame, time: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events a window and kind, on a stream (late ones beyond the watermark are left out) or a table."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def stance_stream(obs: DataFrame, alpha: float = 0.08):
    """Running averages of phase and scope for each session of an ordered stream, by state that is kept for a session."""
    from collections.abc import Iterator

    import pandas as pd

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        p, s, n = state.get if state.exists else (0.0, 0.0, 0)
        for rows in frames:
            for r in rows.sort_values(["timestamp", "id"]).itertuples():
                x, y = (1.0 if r.phase == "act" else -1.0), (1.0 if r.scope == "converge" else -1.0)
                p, s = (x, y) if n == 0 else (alpha * x + (1 - alpha) * p, alpha * y + (1 - alpha) * s)
                n += 1
        state.update((p, s, n))
        yield pd.DataFrame({"session_id": [key[0]], "ema_phase": [p], "ema_scope": [s], "n": [n]})

    kind = "session_id string, ema_phase double, ema_scope double, n long"
    rows = obs.where(F.col("phase").isNotNull() & F.col("scope").isNotNull()).select("session_id", "timestamp", "id", "phase", "scope")
    return rows.groupBy("session_id").applyInPandasWithState(update, kind, "p double, s double, n long", "update", "NoTimeout")


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(do).start()
