"""Streams against the batch versions of the same operators, for several cuts into batches and after a restart."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tracelake import model
from tracelake.model import Tables
from tracelake.operators import episodes, ranking
from tracelake.streaming import live

EVENTS = "session_id string, id long, timestamp long, source string, content string, stop boolean"
SUBJECTS = ["fix the login token check of the server", "write documentation pages about the parser", "deploy the kubernetes cluster with helm charts", "profile slow database queries in production"]


def prompts(sessions: int, each: int) -> list[dict]:
    rng, out = random.Random(3), []
    for s in range(sessions):
        for i in range(each):
            text = rng.choice(["go on", "yes please", *[x + f" part {rng.randrange(3)}" for x in SUBJECTS]])
            out.append({"session_id": f"s{s}", "id": 1 + i * sessions + s, "timestamp": 1000 + 60 * i + s, "source": rng.choice(["user", "user", "user", "agent"]), "content": text, "stop": False})
    return sorted(out, key=lambda x: x["id"])


def run(spark, folder, parts: list[list[dict]], make, schema: str, restart_after: int | None = None) -> list:
    """The rows of a stream of these batches; with a restart, the second query goes on from the first one's checkpoint."""
    data, out = folder / "in", folder / "out"
    data.mkdir()
    for phase in (parts[:restart_after], parts[restart_after:]) if restart_after else (parts,):
        for part in phase:
            n = len(list(data.iterdir()))
            (file := data / f"{n:04d}.json").write_text("\n".join(map(json.dumps, part)))
            os.utime(file, (1_000_000 + n, 1_000_000 + n))  # files are taken in the order of their times
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(data))
        q = make(source).writeStream.option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).outputMode("append").format("parquet").start(str(out))
        q.awaitTermination()
    return spark.read.parquet(str(out)).collect()


@pytest.mark.parametrize("cut,restart", [(1000, None), (17, None), (23, 2)])
def test_episodes_of_a_stream(spark, tmp_path, cut, restart):
    rows = prompts(5, 14)
    last = {r["session_id"]: r for r in rows}
    events = rows + [r | {"id": r["id"] + 1000, "source": "system", "content": None, "stop": True} for r in last.values()]
    got = run(spark, tmp_path, [events[i : i + cut] for i in range(0, len(events), cut)], live.episodes, EVENTS, restart)
    t = Tables(prompts=spark.createDataFrame([(r["id"], r["session_id"], r["timestamp"], r["source"], r["content"]) for r in rows], model.PROMPTS))
    want = [tuple(r) for r in episodes.detect(t).collect()]
    assert sorted(tuple(r)[:7] for r in got) == sorted(want) and len(want) > 12
    assert {r.closed_by for r in got} == {"prompt", "stop"}


def test_idle_sessions_are_closed_and_may_go_on(spark, tmp_path):
    say = lambda i, s, t, x: {"session_id": s, "id": i, "timestamp": t, "source": "user", "content": x, "stop": False}
    parts = [[say(1, "a", 1000, SUBJECTS[0]), say(2, "b", 1010, SUBJECTS[1])], [say(3, "b", 9000, SUBJECTS[1])], [say(4, "b", 9001, "go on")], [say(5, "a", 9100, SUBJECTS[0])], [say(6, "b", 20000, SUBJECTS[2])]]
    got = run(spark, tmp_path, parts, lambda x: live.episodes(x, idle=300, late="10 seconds"), EVENTS)
    assert sorted((r.session_id, r.episode, r.first_prompt_id, r.last_prompt_id, r.closed_by) for r in got if r.session_id == "a") == [("a", 1, 1, 1, "idle"), ("a", 2, 5, 5, "idle")]


@pytest.mark.parametrize("cut", [12, 100])
def test_links_of_a_stream(spark, tmp_path, cut):
    rng = random.Random(6)
    rows = [{"session_id": f"s{rng.randrange(3)}", "id": i, "timestamp": 1000 + 20 * i + rng.randrange(15), "kind": rng.choice(["p", "o", "o"])} for i in range(60)]
    # Later events of both kinds move the watermark past all that counts.
    end = [{"session_id": "end", "id": 900 + i, "timestamp": 90_000 + i, "kind": k} for i, k in enumerate("po")]
    parts = [rows[i : i + cut] for i in range(0, len(rows), cut)] + [end, [x | {"id": x["id"] + 10, "timestamp": x["timestamp"] + 9000} for x in end]]
    split = lambda e: live.linked(e.where("kind = 'o'"), e.where("kind = 'p'"), within="400 seconds", late="60 seconds")
    got = run(spark, tmp_path, parts, split, "session_id string, id long, timestamp long, kind string")
    p = [(r["session_id"], r["timestamp"], r["id"]) for r in rows if r["kind"] == "p"]
    want = {r["id"]: max(((t, i) for s, t, i in p if s == r["session_id"] and r["timestamp"] - 400 <= t <= r["timestamp"]), default=(0, None))[1] for r in rows if r["kind"] == "o"}
    assert {r.id: r.prompt_id for r in got if r.id < 900} == want and len([r for r in got if r.id < 900]) == len(want)
    near = spark.createDataFrame([(r["id"], r["session_id"], r["timestamp"]) for r in rows if r["kind"] == "o"], "id long, session_id string, timestamp long")
    batch = {r.id: r.prompt_id for r in ranking.link_prompts(near.withColumn("x", F.lit(1)), spark.createDataFrame(p, "session_id string, timestamp long, id long")).collect()}
    ages = {i: r["timestamp"] - next((t for s, t, k in p if k == i2), 0) for r in rows if r["kind"] == "o" for i, i2 in [(r["id"], batch[r["id"]])]}
    assert all(want[i] == batch[i] for i, age in ages.items() if age <= 400)
