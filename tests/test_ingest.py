"""Events in, tables out: as a batch and as a stream, which agree; transcripts, settings and sinks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracelake import model
from tracelake.sources import hooks, sinks
from tracelake.streaming import ingest

CWD = "/home/test/workspace/myproj"
EVENTS = [
    {"session_id": "sess-1", "cwd": CWD, "hook_event_name": "SessionStart"},
    {"session_id": "sess-1", "cwd": CWD, "hook_event_name": "UserPromptSubmit", "prompt": "Fix the login bug, password=hunter22"},
    {"session_id": "sess-1", "cwd": CWD, "hook_event_name": "UserPromptSubmit", "prompt": "<system-reminder>no</system-reminder>"},
    {"session_id": "sess-1", "cwd": CWD, "hook_event_name": "PostToolUse", "tool_name": "Read", "tool_input": {"file_path": "/src/auth.rs"}},
    {"session_id": "sess-1", "cwd": CWD, "hook_event_name": "PostToolUse", "tool_name": "Edit", "tool_input": {"file_path": "/src/auth.rs"}},
    {"session_id": "sess-1", "cwd": CWD, "hook_event_name": "PostToolUseFailure", "tool_name": "Bash", "tool_input": {"command": "cargo test"}, "tool_response": "exit code 101"},
    {"session_id": "sess-1", "cwd": CWD, "hook_event_name": "Stop"},
    {"session_id": "", "cwd": CWD, "hook_event_name": "PostToolUse", "tool_name": "Read"},
    {"session_id": "sess-2", "cwd": "/", "hook_event_name": "SessionStart", "source": "compact", "unknown": 1},
    {"session_id": "sess-2", "cwd": "/", "hook_event_name": "Stop"},
]


def lines():
    out = [json.dumps(e | {"event_time": f"2024-01-01T00:00:{i:02d}Z"}) for i, e in enumerate(EVENTS)]
    return [*out, "not json"]


def check(t):
    s = {r.id: r for r in t.sessions.collect()}
    assert (s["sess-1"].project, s["sess-2"].project) == ("myproj", "unknown") and s["sess-1"].ended_at == 1704067206
    assert [x.obs_type for x in s["sess-1"].signature] == ["command", "file_edit", "file_read"] and s["sess-1"].summary is None
    assert json.loads(s["sess-2"].summary)["intent"] == "empty session"
    (p,) = t.prompts.collect()
    assert p.content == "Fix the login bug, [REDACTED]"
    o = t.observations.where("session_id = 'sess-1'").orderBy("timestamp").collect()
    assert [x.obs_type for x in o] == ["file_read", "file_edit", "command"] and {x.prompt_id for x in o} == {p.id}
    assert json.loads(o[2].metadata) == {"failed": True, "response": "exit code 101"} and o[2].novelty == "routine" and o[0].locus == "internal"
    assert [x.obs_type for x in t.observations.where("session_id = 'sess-2'").collect()] == ["session_compact"]


def test_batch(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(lines()))
    events = spark.read.schema(ingest.EVENTS).json(str(tmp_path))
    check(hooks.ingest(events, "event_time"))
    assert hooks.read(spark, str(tmp_path)).where("session_id = 'sess-1'").count() == 7


def test_stream(spark, tmp_path):
    """Events over two files, one of them sent twice, give what the batch gives; a second run adds nothing."""
    folder = tmp_path / "in"
    folder.mkdir()
    for name, part in (("a", lines()[:5]), ("b", lines()[5:]), ("c", lines()[3:5])):
        (folder / f"{name}.json").write_text("\n".join(part))
    for _ in range(2):
        ingest.ingest(ingest.source(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    check(ingest.tables(spark, str(tmp_path / "out")))


def test_rate_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(lines()))
    stream = ingest.rate(ingest.source(spark, str(folder)).where("session_id IS NOT NULL"), "event_time", "hook_event_name")
    stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r.hook_event_name: r.n for r in spark.table("rates").collect()}
    assert got["UserPromptSubmit"] == 2 and got["Stop"] == 2 and got["PostToolUse"] == 3


def test_stance_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(2):
        rows = [{"session_id": "s", "timestamp": n * 10 + i, "id": i, "phase": "act" if i % 3 else "think", "scope": "converge"} for i in range(5)]
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    source = spark.readStream.schema("session_id string, timestamp long, id long, phase string, scope string").option("maxFilesPerTrigger", 1).json(str(folder))
    ingest.stance_stream(source).writeStream.format("memory").queryName("stances").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = max(spark.table("stances").collect(), key=lambda r: r.n)
    e = None
    for i in [0, 1, 2, 3, 4] * 2:
        x = 1.0 if i % 3 else -1.0
        e = x if e is None else 0.08 * x + 0.92 * e
    assert last.n == 10 and last.ema_phase == pytest.approx(e) and last.ema_scope == 1.0


def test_transcript(spark):
    say = lambda kind, text: json.dumps({"type": "assistant", "message": {"content": [{"type": kind, "thinking": text}]}})
    rows = [("s", i, 100 + i, v) for i, v in enumerate([say("thinking", "old"), say("thinking", " first "), say("text", "no"), "{}", "bad", say("thinking", "first"), say("thinking", "known"), say("thinking", "x" * 3000)])]
    have = spark.createDataFrame([(1, "s", 1, "agent", "known")], model.PROMPTS)
    got = sorted((r.content, r.timestamp) for r in hooks.transcript(spark.createDataFrame(rows, "session_id string, line long, t long, value string"), have, from_line=0).collect())
    assert got == [("first", 101), ("x" * 2000, 107)]


def test_settings():
    s = hooks.settings('[filter]\nsensitivity = "strict"\nextra_patterns = ["k-[0-9]+"]\n[retention]\nenabled = true\n[retention.days]\nfile_read = 7\n[other]\nx = 1\n')
    assert (s.sensitivity, s.extra_patterns, s.retention_enabled, s.retention_days) == ("strict", ("k-[0-9]+",), True, {"file_read": 7})
    own = hooks.settings('[filter]\nentropy_threshold = 3.0\ndisable_entropy = false\n[projects.a]\nsensitivity = "relaxed"\n[projects.b]\nsensitivity = "default"\n[projects.c]\nx = 1\n')
    assert (own.entropy_threshold, own.disable_entropy, own.projects) == (3.0, False, {"a": "relaxed", "b": "normal"})
    assert hooks.settings("") == hooks.Settings()


def test_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines()))
    t = hooks.ingest(spark.read.schema(ingest.EVENTS).json(str(tmp_path / "in")), "event_time")
    sinks.write_logs(sinks.log_records(t.observations), str(tmp_path / "logs"))
    back = spark.read.json(str(tmp_path / "logs"))
    assert back.count() == 4 and {str(r.day) for r in back.select("day").distinct().collect()} == {"2024-01-01"}
    assert {json.loads(r.value)["id"] for r in sinks.as_json(t.observations.select("id")).collect()} == {r.id for r in t.observations.collect()}
    assert sinks.id_list(spark.range(3)).first().ids == "0,1,2"
    assert {(r.obs_type, r.total) for r in sinks.counters(t.observations).collect()} == {("file_read", 1), ("file_edit", 1), ("command", 1), ("session_compact", 1)}
    sinks.write_table(t.observations.withColumn("day", F.lit("d")), str(tmp_path / "t"), by="day")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_limits_of_redaction(spark):
    """A user's own limits and those of a project decide what goes."""
    token = "abcdefghij1234567"  # 17 bytes of 4.09 bits
    df = spark.createDataFrame([("/w/strict", token), ("/w/other", token)], "cwd string, text string")
    run = lambda s: {r[0]: r[1] for r in df.select("cwd", hooks.redacted(F.col("text"), F.col("cwd"), s)).collect()}
    gone, kept = "[REDACTED]", token
    assert run(hooks.Settings()) == {"/w/strict": kept, "/w/other": kept}
    assert run(hooks.Settings(projects={"strict": "strict"})) == {"/w/strict": gone, "/w/other": kept}
    assert run(hooks.Settings(entropy_min_length=10)) == {"/w/strict": gone, "/w/other": gone}
    assert run(hooks.Settings(sensitivity="strict", projects={"other": "relaxed"})) == {"/w/strict": gone, "/w/other": kept}
    assert run(hooks.Settings(sensitivity="strict", disable_entropy=True)) == {"/w/strict": kept, "/w/other": kept}
