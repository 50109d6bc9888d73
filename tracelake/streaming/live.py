"""Streams that keep state: work episodes as prompts arrive, and observations linked to the prompts they follow."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracelake.functions.scalar import intent_keywords, word_count
from tracelake.operators.episodes import SIMILAR, TERSE

if TYPE_CHECKING:
    import pandas as pd

EPISODES = "session_id string, episode long, started_at long, ended_at long, intent string, first_prompt_id long, last_prompt_id long, closed_by string"
#: The store that state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Sets the state store; a cluster may have set it already."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Episodes(StatefulProcessor):
    """The fold of ``operators.episodes.detect``, a prompt at a time; the state of a session is its open episode."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "episode long, started_at long, ended_at long, intent string, first_prompt_id long, last_prompt_id long, words array<string>, timer long")

    def _closed(self, key: tuple, e: list, by: str) -> tuple:
        return (key[0], *e[:6], by)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        import pandas as pd

        state = self.open.get() if self.open.exists() else None
        number, e, timer = (state[0], list(state[:6]) if state[4] is not None else None, state[7]) if state else (0, None, None)
        words, out = set(state[6] or ()) if e else set(), []
        for r in pd.concat(list(rows)).sort_values(["id", "stop"], kind="stable").itertuples():
            if r.stop:
                if e:
                    out.append(self._closed(key, e, "stop"))
                e, words = None, set()
                continue
            new = set(r.words) if r.words is not None else set()
            if e and (r.terse or len(words & new) >= max(len(words | new), 1) * SIMILAR):
                e[2], e[5] = int(r.timestamp), int(r.id)
                words |= set() if r.terse else new
                continue
            if e:
                out.append(self._closed(key, e, "prompt"))
            number += 1
            e = [number, int(r.timestamp), int(r.timestamp), r.content, int(r.id), int(r.id)]
            words = set() if r.terse else new
        if timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        if e and self.idle:
            timer = e[2] * 1000 + self.idle * 1000
            if timer <= timerValues.getCurrentWatermarkInMs():
                timer = timerValues.getCurrentWatermarkInMs() + 1
            self.handle.registerTimer(timer)
        # The number of the last episode stays, so that a session which goes on goes on counting.
        self.open.update((*e, sorted(words), timer) if e else (number, None, None, None, None, None, None, None))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in EPISODES.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import pandas as pd

        state = self.open.get()
        out = []
        if state and state[4] is not None:
            out.append(self._closed(key, list(state[:6]), "idle"))
            self.open.update((state[0], None, None, None, None, None, None, None))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in EPISODES.split(", ")])

    def close(self) -> None:
        pass


def episodes(events: DataFrame, idle: int = 0, late: str = "10 minutes") -> DataFrame:
    """Episodes of a stream ``session_id, id, timestamp (seconds), source, content, stop``, each once it is closed.

    A prompt on another subject closes an episode, as in ``operators.episodes.detect``; so does an event with ``stop``; and, if
    ``idle`` seconds are given, event time that goes on so long without a prompt (``late`` is how far events may be out of order).
    Within a batch, a session's events are taken by id, a stop after the prompt of its id; a prompt that comes in a later
    batch than one of a higher id is taken when it comes. Only the users' prompts count. Batches may be cut anywhere.
    """
    with_store(events.sparkSession)
    e = events.where((F.col("source") == "user") | F.col("stop"))
    rows = e.select("session_id", "id", "timestamp", "content", F.coalesce("stop", F.lit(False)).alias("stop"), (word_count(F.col("content")) < TERSE).alias("terse"), F.array_distinct(intent_keywords(F.col("content"))).alias("words"), F.timestamp_seconds("timestamp").alias("event_time"))
    rows = rows.withWatermark("event_time", late)
    return rows.groupBy("session_id").transformWithStateInPandas(Episodes(idle), EPISODES, "append", "eventtime" if idle else "none")


def linked(observations: DataFrame, prompts: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``id, session_id, timestamp, prompt_id``: each observation of a stream with the newest prompt of its session at its time.

    Both streams have ``session_id, id, timestamp (seconds)``. A prompt counts for ``within`` after it was given; an observation
    without one has null. Rows are given once the watermark, ``late`` behind the newest event of the slower stream, has passed
    them; what comes later than that is left out. At equal times the prompt comes first, and of two prompts the higher id counts.
    """
    o = observations.select(F.col("session_id").alias("o_session"), F.col("id").alias("o_id"), F.timestamp_seconds("timestamp").alias("o_time")).withWatermark("o_time", late)
    p = prompts.select(F.col("session_id").alias("p_session"), F.col("id").alias("p_id"), F.timestamp_seconds("timestamp").alias("p_time")).withWatermark("p_time", late)
    on = (F.col("o_session") == F.col("p_session")) & (F.col("p_time") <= F.col("o_time")) & (F.col("p_time") >= F.col("o_time") - F.expr(f"INTERVAL {within}"))
    newest = F.max(F.when(F.col("p_id").isNotNull(), F.struct("p_time", "p_id")))["p_id"]
    rows = o.join(p, on, "leftOuter").groupBy("o_time", "o_session", "o_id").agg(newest.alias("prompt_id"))
    return rows.select(F.col("o_id").alias("id"), F.col("o_session").alias("session_id"), F.unix_timestamp("o_time").alias("timestamp"), "prompt_id")
