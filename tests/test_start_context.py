"""What starts of sessions are told: all at once, against one after the other."""

from __future__ import annotations

import random
import tomllib
from dataclasses import replace

from pyspark.sql import functions as F

from tests.test_operators import observations, sessions
from tracelake import model
from tracelake.model import Tables
from tracelake.operators import code_history, context, fleet, start_context
from tracelake.plans import queries
from tracelake.sources import driver_tables, hooks, sinks
from tracelake.streaming import ingest

DAY, NOW = 86400, 1_707_500_000


def random_tables(spark, seed: int = 5) -> Tables:
    """Many ties in time, a project with most of all, pins in one project only for a while, poor intents, nulls."""
    r = random.Random(seed)
    projects = ["hot"] * 6 + ["b", "c|d", "none"]
    s = [(f"s{i}", r.choice(projects), NOW - r.randrange(6 * DAY), 1, r.choice([None, '{"intent":"a longer intent","next_steps":["x","y"]}', f'{{"next_steps":["n{i}","x"]}}', "no json"])) for i in range(60)]
    o, w = [], []
    for i in range(900):
        kind = r.choice(["file_edit", "file_edit", "git_commit", "git_push", "file_read", "command"])
        o.append({"id": i, "session_id": f"s{r.randrange(60)}", "timestamp": NOW - r.randrange(400) * 600, "obs_type": kind, "file_path": None if kind[0] in "gc" else r.choice(["/a|b", "/c", "/d"]), "content": r.choice([None, "short", "long " * 30]), "is_pinned": r.random() < 0.1})
    for i in range(150):
        n = r.randrange(60)
        learned = r.choice(['["one","two","three","four"]', '"text"', "null"])
        w.append((f"s{n}", i, NOW - r.randrange(300) * 1200, NOW, r.choice([None, "ok", "a good intent it is"]), 1, 1, ["/x", "/y"][: r.randrange(3)], (r.randrange(3), r.randrange(3)) + (0,) * 9, r.randrange(4), r.choice([None, f'{{"learned":{learned},"next_steps":["w{i % 7}"]}}']), None))
    return Tables(sessions=sessions(spark, s), observations=observations(spark, o), work_units=spark.createDataFrame(w, model.WORK_UNITS))


def test_starts_equal_single_contexts(spark):
    t = random_tables(spark)
    r = random.Random(1)
    rows = [(f"n{i}", r.choice(["hot", "b", "c|d", "none", "new"]), NOW - r.randrange(400) * 600, r.random() < 0.5) for i in range(8)] + [("n99", "hot", NOW - 20 * DAY, False)]
    kind = "session_id string, project string, t long, recovery boolean"
    starts = spark.createDataFrame(rows + rows[:3] + [("x", None, NOW, False), ("y", "hot", None, False)], kind)
    for tables in (t, replace(t, work_units=t.work_units.limit(0))):
        got = {x.session_id: x.context for x in start_context.at_starts(tables, starts).collect()}
        want = {n: context.render(tables, p, as_of=at, recovery=again) for n, p, at, again in (rows if tables is t else rows[:2])}
        assert {n: got.get(n, "") for n in want} == want
        assert set(got) <= {x[0] for x in rows} and any(got.values())


def test_latest_of_others(spark):
    """Against plain Python; most pins are of one project, times tie, limits reach 0 and beyond all there is."""
    r = random.Random(3)
    pins = [(r.choice("aaaaab"), r.randrange(40) * 1000, i) for i in range(120)]
    starts = [(p, at, f"{p}{at}{k}", k) for p in "abz" for at in (0, 7000, 20000, 50000) for k in (0, 1, 5, 500)]
    marks = spark.createDataFrame(pins, "project string, at long, id long").withColumn("m", F.struct("id"))
    s = spark.createDataFrame(starts, "project string, at long, name string, k long").select("project", "at", F.struct("name", "k").alias("s"))
    plain = lambda at, k, keep: sorted(i for _, i in sorted((t, i) for p, t, i in pins if t < at and keep(p))[::-1][:k])
    for found, same in ((start_context.latest_of_others(marks, s, ["id"], F.col("s.k")), False), (start_context.latest(marks, s, ["id"], F.col("s.k")), True)):
        got: dict = {}
        for x in found.collect():
            got.setdefault(x.s["name"], []).append(x.m["id"])
        assert {n: sorted(got.get(n, [])) for _, _, n, _ in starts} == {n: plain(at, k, lambda x, p=p: (x == p) == same) for p, at, n, k in starts}


def test_empty(spark):
    none = Tables(sessions=sessions(spark, []), observations=observations(spark, []))
    starts = spark.createDataFrame([("a", "p", 5)], "session_id string, project string, t long")
    assert start_context.at_starts(none, starts).collect() == [] and start_context.at_starts(none, starts.limit(0)).collect() == []


def test_starts_of_events(spark):
    s = hooks.settings('[projects.a]\ncontext_local_limit = 1\nsuppress_cross_project = true\n[projects.b]\ncontext_episode_window_hours = 2\n')
    assert s.contexts == {"a": hooks.ContextLimits(1, 0, None), "b": hooks.ContextLimits(None, None, 2)}
    rows = [("s1", "/w/a", "SessionStart", "compact", 100), ("s1", "/w/b", "SessionStart", None, 200), ("s1", "/w/b", "Stop", None, 300)]
    e = spark.createDataFrame(rows, "session_id string, cwd string, hook_event_name string, source string, t long")
    got = [tuple(x) for x in hooks.starts(e, s).orderBy("t").collect()]
    assert got == [("s1", "a", 100, True, 1, 0, None), ("s1", "b", 200, False, None, None, 2)]
    o = [{"id": i, "session_id": f"s{i % 2}", "timestamp": 90 + i, "obs_type": "file_edit", "file_path": f"/f{i}", "is_pinned": True} for i in range(6)]
    t = Tables(sessions=sessions(spark, [("s0", "a", 1, 1, None), ("s1", "b", 1, 1, None)]), observations=observations(spark, o))
    told = {x.project: x.context for x in start_context.at_starts(t, hooks.starts(e, s)).collect()}
    assert told["a"].count("\n- ") == 1 and "/f4 (pinned)" in told["a"] and "Elsewhere" not in told["a"] and told["b"].count("\n- ") == 6


def test_settings_of_instances():
    s = hooks.settings('[summarization]\nenabled = true\nmodel_path = "m"\nmax_tokens = 9\ntemperature = 1\n[beacon]\nidentity = "i"\nrespond = false\nlimit = 3\n')
    assert s.summarization == hooks.Summarization(True, "m", None, 1.0, 9, None) and s.beacon == hooks.Beacon(None, "i", False, 3)
    assert hooks.settings("").beacon == hooks.Beacon() and hooks.settings("").contexts == {}


def test_contexts_of_a_stream(spark, tmp_path):
    """Starts in a batch are told what earlier batches brought; the first has nothing to tell."""
    import json

    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    event = lambda sid, at, kind, **more: {"session_id": sid, "cwd": "/w/a", "hook_event_name": kind, "event_time": f"2024-02-09T10:{at:02d}:00Z", **more}
    edit = {"tool_name": "Edit", "tool_input": json.dumps({"file_path": "/w/a/x.py", "new_string": "y"})}
    run = lambda: ingest.ingest(ingest.source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), contexts=True).awaitTermination()
    put("1.json", [event("s1", 1, "SessionStart", source="startup"), event("s1", 2, "PostToolUse", **edit)])
    run()
    put("2.json", [event("s2", 5, "SessionStart", source="compact")])
    run()
    got = [(x.session_id, x.context) for x in spark.read.parquet(str(tmp_path / "out" / "contexts")).collect()]
    assert got == [("s2", "## Recent Activity\n- /w/a/x.py (3m ago)\n")]


def test_query_of_contexts(spark):
    """The registered query against single contexts."""
    d = "/root/testdata/sf0.001"
    t = queries.with_episodes(driver_tables.tables(spark, d))
    got = queries.start_contexts(spark, d).collect()
    assert len(got) > 50
    ends = {x.id: x.ended_at for x in t.sessions.collect()}
    for x in sorted(got, key=lambda x: (x.session_id, x.t))[:: max(1, len(got) // 3)]:
        assert x.context == context.render(t, x.project, as_of=x.t, recovery=x.t == ends[x.session_id] + 1)


def test_module_maps(spark):
    files = spark.createDataFrame([("src/a.rs", 'use crate::b;\nuse crate::zzz;\npub fn f() {}\npub struct S;\n'), ("k/src/b.rs", "pub async fn g() {}"), ("src/c.rs", "")], "path string, text string")
    m, u = hooks.rust_modules(files)
    own = {x.file: tomllib.loads(x.text) for x in sinks.module_files(m, u).collect()}
    a = own["src--a.toml"]
    assert a["module"] == {"name": "src/a", "path": "src/a.rs", "lines": 4} and a["coordination"]["deps"] == ["b", "zzz"] and a["control"] == {"lines": 4, "dep_count": 2}
    assert a["policy"] == {"pub_fns": ["f"], "pub_types": ["S"]} and a["items"] == [{"name": "f", "kind": "function"}, {"name": "S", "kind": "type"}]
    assert "items" not in own["src--c.toml"] and len(own) == 3
    p = tomllib.loads(sinks.project_map(m, u, 'a "b" \\c', 7, "abc"))
    assert p["project"] == {"name": 'a "b" \\c', "git_hash": "abc", "scanned_at": 7, "module_count": 3, "total_lines": 5}
    assert p["modules"]["src/a"]["pub_items"] == ["f", "S"] and p["modules"]["src/c"]["deps"] == []
    roles = code_history.module_roles(m, u)
    g = tomllib.loads(sinks.graph_map(roles, code_history.rankings(roles)))
    assert g["graph"] == {"total_modules": 3, "total_edges": 1, "foundation": ["k/b"], "leaf": ["src/a", "src/c"]}
    assert g["ranking"]["by_lines"] == ["src/a", "k/b", "src/c"] and g["modules"]["k/b"]["role"] == "foundation"
    empty = tomllib.loads(sinks.project_map(m.limit(0), u.limit(0), "p", 7))
    assert empty["project"]["module_count"] == 0 and sinks.module_files(m.limit(0), u).count() == 0


def test_quality_of_documents(spark):
    rows = [("d", 5, 5, True, False), ("d", 5, 4, True, True), ("d", 5, 5, None, True), ("d", 5, 4, True, None), ("e", 3, None, True, False), ("e", 0, 0, None, None), ("f", 1, 1, False, True)]
    c = spark.createDataFrame(rows, "document string, n long, k long, tagged boolean, wrong boolean")
    q = {x.document: x for x in fleet.document_quality(c).collect()}
    assert (q["d"].agreement, q["d"].majority_right, q["d"].calibration, q["d"].quality) == (0.9, 0.99144, 0.666667, 0.66096)
    assert (q["e"].n, q["e"].agreement, q["e"].calibration, q["e"].quality) == (None, None, 1.0, None) and q["f"].quality == 1.0
    tiers = {(x.document, x.k): (x.claims, x.expected) for x in fleet.agreement_tiers(c).collect()}
    assert tiers == {("d", 5): (2, 2.362), ("d", 4): (2, 1.3122), ("f", 1): (1, 1.0)}
    assert fleet.document_quality(c.limit(0)).count() == 0
    found = spark.createDataFrame([(2, -1.0), (1, -1.0), (3, -5.0)], "id long, rank double")
    assert [x.id for x in fleet.answer(found, True, 2).collect()] == [3, 1] and fleet.answer(found, False, 2).count() == 0


def test_starts_full_of_pins_are_not_numbered_again(spark, monkeypatch):
    """A start with as many pins as it may be told asks for no edits; one with fewer still is told them, newest first."""
    t = random_tables(spark)
    starts = spark.createDataFrame([(f"n{k}", "hot", NOW, k) for k in (0, 1, 3, 500)], "session_id string, project string, t long, local_limit long")
    asked, latest = [], start_context.latest

    def noted(marks, probes, order, k, by=("project",)):
        if "kind" in by and "edit" in (kinds := {r.kind for r in probes.select("kind").collect()}):
            assert kinds == {"edit", "git"}
            asked.extend(sorted({r[0] for r in probes.select("s.session_id").collect()}))
        return latest(marks, probes, order, k, by)

    monkeypatch.setattr(start_context, "latest", noted)
    got = {r.session_id: r.context for r in start_context.at_starts(replace(t, work_units=t.work_units.limit(0)), starts).collect()}
    assert asked == ["n0", "n500"]
    lines = {n: [x for x in text.split("## Pinned Elsewhere")[0].partition("## Recent Activity\n")[2].split("\n") if x] for n, text in got.items()}
    assert [len(lines[n]) for n in ("n0", "n1", "n3")] == [0, 1, 3] and all("(pinned)" in x for n in ("n1", "n3") for x in lines[n])
    assert any("(pinned)" in x for x in lines["n500"])
