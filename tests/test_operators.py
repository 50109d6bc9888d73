"""Operators over small tables with known results."""

from __future__ import annotations

import json
import random
import sqlite3
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracelake import model
from tracelake.model import Tables
from tracelake.operators import classify, code_history, context, episodes, fleet, lifecycle, patterns, ranking, search, stance
from tracelake.sources import sinks

NOW = 1_707_500_000


def observations(spark, rows):
    """Rows of named fields; those that are left out are null."""
    names = [x.split()[0] for x in model.OBSERVATIONS.split(", ")]
    full = [tuple({"is_pinned": False, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, model.OBSERVATIONS)


def sessions(spark, rows):
    names = [x.split()[0] for x in "id string, project string, started_at long, ended_at long, summary string".split(", ")]
    return spark.createDataFrame([tuple(dict(zip(("id", "project", "started_at", "ended_at", "summary"), r)).get(n) for n in names) for r in rows], "id string, project string, started_at long, ended_at long, summary string")


@pytest.fixture(scope="module")
def t(spark):
    obs = [
        (1, "sess-a", 1, 1707400020, "file_read", "/src/auth.rs", "Read /src/auth.rs", None),
        (2, "sess-a", 1, 1707400030, "file_edit", "/src/auth.rs", "Edit /src/auth.rs: fix token validation", '{"redacted":false}'),
        (3, "sess-a", 1, 1707400040, "command", None, "cargo test -- auth::tests", None),
        (4, "sess-a", 1, 1707400050, "command_error", None, "cargo test failed with assertion error on line 42", None),
        (5, "sess-b", None, 1707400110, "file_read", "/src/main.rs", "Read /src/main.rs for other project", None),
        (6, "sess-a", 1, 1707400060, "file_edit", "/src/auth.rs", "Edit /src/auth.rs: second edit to fix tests", None),
    ]
    names = ("id", "session_id", "prompt_id", "timestamp", "obs_type", "file_path", "content", "metadata")
    return Tables(
        sessions=sessions(spark, [("sess-a", "myproj", 1707400000, None, None), ("sess-b", "other", 1707400100, None, None)]),
        prompts=spark.createDataFrame([(1, "sess-a", 1707400010, "user", "Fix the login bug")], model.PROMPTS),
        observations=observations(spark, [dict(zip(names, o)) for o in obs]),
    )


def ids(df):
    return [r["id"] for r in df.collect()]


def test_timeline(t):
    rows = ranking.timeline(t, 3, before=2, after=2).collect()
    assert [(r.id, r.side) for r in rows] == [(1, -1), (2, -1), (3, 0), (4, 1), (6, 1)]
    assert ids(ranking.timeline(t, 1, before=2, after=1).where("side = 1")) == [2]
    with pytest.raises(ValueError, match="anchor observation not found"):
        ranking.timeline(t, 9999)


def test_recent_context(t):
    rows = ranking.recent_context(t, as_of=NOW, project="myproj").collect()
    assert [(r.obs_type) for r in rows if r.file_path == "/src/auth.rs"] == ["file_edit"] and sum(r.file_path is None for r in rows) == 2
    assert 5 in ids(ranking.recent_context(t, as_of=NOW, project="other"))
    assert all(r.score > 0 for r in ranking.recent_context(t, as_of=NOW, project="nope").collect())
    assert ids(ranking.recent_context(t, as_of=NOW, project="other"))[0] in (2, 6, 5)


def scored(spark, rows, project=None):
    obs = observations(spark, [{"id": i, "session_id": s, "timestamp": NOW - age, "obs_type": k, "file_path": p, "content": p} for i, (s, age, k, p) in enumerate(rows)])
    own = Tables(sessions=sessions(spark, [("s1", "proj-a", 0), ("s2", "proj-b", 0)]), observations=obs)
    return ids(ranking.recent_context(own, as_of=NOW, project=project))


def test_scores(spark):
    assert scored(spark, [("s1", 0, "file_read", "a"), ("s1", 0, "file_edit", "b"), ("s1", 0, "command", "c")]) == [1, 2, 0]
    assert scored(spark, [("s1", 14 * 86400, "file_edit", "a"), ("s1", 0, "file_read", "b")]) == [1, 0]
    assert scored(spark, [("s1", 0, "file_edit", "a"), ("s2", 0, "file_edit", "b")], "proj-a") == [0, 1]
    assert scored(spark, [("s1", 0, "file_read", "a"), ("s1", 0, "file_edit", "a")]) == [1]


def test_lookups(t):
    assert ids(ranking.get_observations(t, [4, 77, 1])) == [4, 1]
    for bad in ([], list(range(51))):
        with pytest.raises(ValueError):
            ranking.get_observations(t, bad)
    (row,) = ranking.session_trace(t, "sess-a").collect()
    assert row.prompt_id == 1 and [o.id for o in row.observations] == [1, 2, 3, 4, 6]
    assert [x.id for r in ranking.session_trace(t, "sess-a", before=1707400035).collect() for x in r.observations] == [1, 2]
    assert [r.prompt_id for r in ranking.session_trace(t, "sess-a", after=1707400015).collect()] == []
    assert ranking.session_head(t, "sess-a")["project"] == "myproj"
    with pytest.raises(ValueError, match="session not found"):
        ranking.session_trace(t, "nonexistent")
    (loose,) = ranking.session_trace(t, "sess-b").where("source = 'system'").collect()
    assert [o.id for o in loose.observations] == [5]
    history = lambda **k: [(r.session_id, r.n_touches) for r in ranking.file_history(t, "/src/auth.rs", **k).collect()]
    assert history() == [("sess-a", 3)] and history(before=1707400035) == [("sess-a", 2)] and history(limit=1) == [("sess-a", 1)]
    assert ranking.file_history(t, "/none").collect() == []
    assert ranking.session_summaries(t).collect() == []
    (s,) = ranking.status(t).collect()
    assert (s.observations, s.sessions, s.prompts, s.last_session) == (6, 2, 1, "sess-b")
    sig = {r.session_id: [(x.obs_type, x.n) for x in r.signature] for r in ranking.signatures(t).collect()}
    assert sig["sess-a"] == [("file_edit", 2), ("command", 1), ("command_error", 1), ("file_read", 1)]


def test_prompt_links(spark):
    p = spark.createDataFrame([(1, "s", 10, "user", "a"), (2, "s", 20, "user", "b"), (3, "z", 5, "user", "c")], model.PROMPTS)
    o = observations(spark, [{"id": i, "session_id": "s", "timestamp": ts} for i, ts in enumerate((5, 10, 15, 20, 99))])
    assert {r.id: r.prompt_id for r in ranking.link_prompts(o, p).collect()} == {0: None, 1: 1, 2: 1, 3: 2, 4: 2}


def test_stance(spark):
    points = [("think", "diverge")] * 10 + [("act", "converge")] * 30 + [("act", "diverge")] * 30
    obs = observations(spark, [{"id": i, "session_id": "s", "timestamp": i, "phase": p, "scope": s, "novelty": "novel" if i < 7 else "routine", "friction": "smooth"} for i, (p, s) in enumerate(points)])
    own = Tables(observations=obs)
    e, series = None, []
    for p, s in points:
        x = (1 if p == "act" else -1, 1 if s == "converge" else -1)
        e = x if e is None else tuple(0.08 * a + 0.92 * b for a, b in zip(x, e))
        series.append(e)
    (row,) = stance.current(own).collect()
    assert (row.ema_phase, row.ema_scope) == tuple(round(v, 6) for v in series[-1]) and row.scope_5 == -1 and row.stance == "act+diverge"
    crossings = [i for i in range(max(len(points) - 50, 0) + 1, len(points)) if (series[i - 1][1] >= 0) != (series[i][1] >= 0)]
    assert [r.at_observation for r in stance.shifts(own, as_of=1000).orderBy("at_observation").collect()] == crossings and crossings
    (q,) = stance.quadrants(own).collect()
    assert (q.n_think_diverge, q.n_act_converge, q.n_act_diverge, q.pct_act_converge) == (10, 30, 30, 42.9)
    (d,) = stance.dimensions(own).collect()
    assert (d.n_novel, d.permille_novel, d.permille_internal, d.routine_smooth) == (7, 100, None, 63)
    assert stance.current(Tables(observations=obs.where("id < 1"))).first().n == 1


def prompts(spark, texts):
    return spark.createDataFrame([(i + 1, "s", 1000 + 10 * i, "user", x) for i, x in enumerate(texts)], model.PROMPTS)


@pytest.mark.parametrize(
    ("texts", "n"),
    [
        (["fix the authentication bug in the login handler", "update the authentication test for the login fix", "commit the authentication login handler fix"], 1),
        (["fix the authentication bug in the login handler", "update the authentication test for the login fix", "now refactor the database schema migration system", "add a new migration for the users table schema"], 2),
        (["fix the authentication bug in the login handler", "yes", "ok do it", "looks good"], 1),
        (["fix the authentication bug in the login handler"], 1),
        (["ok", "fix the authentication bug in the login handler"], 2),
    ],
)
def test_episodes(spark, texts, n):
    e = episodes.detect(Tables(prompts=prompts(spark, texts))).collect()
    assert len(e) == n and e[0].intent == texts[0] and e[-1].last_prompt_id == len(texts)


def test_no_episodes(spark):
    assert episodes.detect(Tables(prompts=prompts(spark, ["x"]).limit(0))).collect() == []


def test_annotation(spark):
    own = Tables(
        prompts=prompts(spark, ["fix the authentication bug in the login handler"]),
        observations=observations(
            spark,
            [
                {"id": 1, "session_id": "s", "prompt_id": 1, "timestamp": 1005, "obs_type": "file_read", "file_path": "/b", "metadata": '{"failed":true}'},
                {"id": 2, "session_id": "s", "prompt_id": 1, "timestamp": 1001, "obs_type": "file_read", "phase": "act", "file_path": "/a"},
                {"id": 3, "session_id": "s", "prompt_id": 1, "timestamp": 1003, "obs_type": "file_edit", "phase": "think", "file_path": "/a"},
                {"id": 4, "session_id": "s", "prompt_id": 1, "timestamp": 1009, "obs_type": "command", "scope": "converge"},
                {"id": 5, "session_id": "s", "prompt_id": 9, "timestamp": 1009, "obs_type": "command", "friction": "smooth"},
            ],
        ),
    )
    (w,) = episodes.annotate(own, episodes.detect(own)).collect()
    s = w.phase_signature
    assert (w.obs_count, w.hot_files, s.investigate, s.execute, s.failures, s.converge) == (4, ["/a", "/b"], 2, 2, 1, 1)
    trace = json.loads(w.obs_trace)
    assert [x["t"] for x in trace] == [1001, 1003, 1005, 1009] and trace[0] == {"t": 1001, "type": "file_read", "fp": "/a", "p": "act"} and trace[2]["fail"] is True
    labels = {r.id: r.friction for r in episodes.label_friction(own, episodes.annotate(own, episodes.detect(own))).collect()}
    assert labels == {1: "friction", 2: "friction", 3: "friction", 4: "friction", 5: None}
    again = episodes.store(episodes.detect(own), episodes.detect(own))
    assert again.count() == 1


def failures(spark, cells, responses=None):
    obs = [{"id": i, "session_id": s, "timestamp": NOW - age, "obs_type": "command", "content": c, "metadata": json.dumps({"failed": True, "response": (responses or {}).get(i, "x")})} for i, (s, age, c) in enumerate(cells)]
    return Tables(observations=observations(spark, obs))


def test_failed_commands(spark):
    run = lambda cells: [(r.pattern, r.session_count) for r in patterns.failed_commands(failures(spark, cells), as_of=NOW).collect()]
    assert run([(f"s{i}", 0, "cargo test 2>&1") for i in range(4)]) == [("cargo test", 4)]
    assert run([(f"s{i}", 0, "cargo test") for i in range(2)]) == []
    assert run([("a", 0, "cargo test"), ("b", 0, "~/.cargo/bin/cargo test"), ("c", 0, "/home/u/.cargo/bin/cargo test x | tail -3")]) == [("cargo test", 3)]
    hot = patterns.normalised(patterns.failed_commands(failures(spark, [(f"h{i}", 600 * i, "make a") for i in range(3)] + [(f"c{i}", 30 * 86400, "make b") for i in range(3)]), as_of=NOW)).collect()
    assert {r.pattern: r.heat for r in hot}["make a"] == 100 and {r.pattern: r.heat for r in hot}["make b"] <= 10


def test_other_patterns(spark):
    reads = [{"id": i, "session_id": f"s{i % 3}", "timestamp": NOW, "obs_type": "file_read", "file_path": p} for i, p in enumerate(["/src/mystery.rs"] * 3 + ["/src/docs/a.md"] * 3 + ["/src/known.rs"] * 3)]
    edit = {"id": 99, "session_id": "s0", "timestamp": NOW, "obs_type": "file_edit", "file_path": "/src/known.rs"}
    assert [r.pattern for r in patterns.unresolved_reads(Tables(observations=observations(spark, [*reads, edit])), as_of=NOW).collect()] == ["/src/mystery.rs"]
    e = failures(spark, [(f"s{i}", 0, f"run {i}") for i in range(3)], dict.fromkeys(range(3), "warn\nerror: cargo: command not found"))
    errors = patterns.recurring_errors(e, as_of=NOW)
    assert [(r.pattern, r.session_count) for r in errors.collect()] == [("error: cargo: command not found", 3)]
    intents = ["fix the login authentication bug", "fix login authentication bug again", "fix the authentication login bug now"]
    like = Tables(sessions=sessions(spark, [(f"s{i}", "p", i, None, json.dumps({"intent": x})) for i, x in enumerate(intents)]))
    found = patterns.repeated_intents(like, as_of=NOW)
    assert [(r.session_count, r.example) for r in found.collect()] == [(3, intents[2])]
    unlike = Tables(sessions=sessions(spark, [(f"s{i}", "p", i, None, json.dumps({"intent": x})) for i, x in enumerate(["write docs pages", "deploy kubernetes cluster", "refactor parser module"])]))
    assert patterns.repeated_intents(unlike, as_of=NOW).collect() == []
    assert [(r.kind, r.shared_sessions) for r in patterns.stuck_loops(found, errors).collect()] == [("recurring_error", 3)]
    assert "error: cargo" in context.pattern_report(errors)


def test_seeds_of_intents(spark):
    """Greedy clusters, chains among them, as one pass in order makes them."""
    import random

    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(14)]
    rows, seen = [], set()
    for i in range(150):
        words = sorted(set(rng.choices(vocabulary, k=rng.randint(1, 6))))
        if " ".join(words) not in seen:
            seen.add(" ".join(words))
            rows.append((" ".join(words), (rng.randrange(40), f"s{i}"), words))
    want = {}
    for bag, _, words in (inorder := sorted(rows, key=lambda r: r[1])):
        if bag not in want:
            want |= {b: bag for b, first, w in inorder if b not in want and (b == bag or 10 * len(set(w) & set(words)) >= 4 * len(set(w) | set(words)))}
    df = spark.createDataFrame(rows, "bag string, first struct<started_at:long,id:string>, words array<string>")
    assert {r.bag: r.seed for r in patterns._seeds(df).collect()} == want and 3 < len(set(want.values())) < len(want)


TEXTS = ["the quick brown fox", "quick brown dogs and the fox", "a fox is quick", "brown bread", "", "running foxes run; the runner ran", "quick quick quick", "brown quick"]


@pytest.mark.parametrize("query", ["quick", "quick AND brown", "quick OR bread", "quick NOT fox", '"quick brown"', "qui*", "quick brown", "the AND quick OR bread", '"brown fox" OR bread', "fox NOT the", "missing", "run*", "fox NOT the quick", "quick brown NOT fox the", "quick NOT fox NOT brown", "brown OR fox NOT quick", "fox AND quick NOT the OR bread", "quick OR bread AND brown NOT fox"])
@pytest.mark.parametrize("stemmed", [False, True])
def test_search_like_sqlite(spark, query, stemmed):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize='{'porter ' if stemmed else ''}unicode61')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(TEXTS))
    want = {i: round(r, 6) for i, r in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (query,))}
    index = search.build(spark.createDataFrame(list(enumerate(TEXTS)), "id long, x string"), "id", "x", stemmed)
    assert {r["doc"]: round(r["rank"], 6) for r in search.matches(index, query).collect()} == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("query", ["NOT quick", "quick AND", "OR", "quick NOT", "quick AND OR fox"])
def test_search_errors_like_sqlite(query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    with pytest.raises(sqlite3.OperationalError):
        db.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,)).fetchall()
    with pytest.raises(ValueError):
        search.parse(query)


@pytest.mark.parametrize("stemmed", [False, True])
def test_stored_index(spark, tmp_path, stemmed):
    """A stored index finds what one on the fly does, and reads the terms' buckets only."""
    index = search.build(spark.createDataFrame(list(enumerate(TEXTS)), "id long, x string"), "id", "x", stemmed)
    own = search.store(index, str(tmp_path / "i"))
    for query in ("quick", "quick brown NOT fox", '"quick brown" OR run*', '"brown fo*" OR bread', "missing"):
        have, want = ({r["doc"]: round(r["rank"], 6) for r in search.matches(x, query).collect()} for x in (own, index))
        assert have == want
    plan = search.matches(own, "quick")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert [r["tier"] for r in search.tiered(own, "brown quick").collect()] == [r["tier"] for r in search.tiered(index, "brown quick").collect()]


def test_search_observations(spark, t):
    index = search.build(t.observations, "id", "content")
    run = lambda **k: ids(search.observations(index, t, "auth OR cargo OR read OR editing OR main", as_of=NOW, **k))
    assert set(run()) == {1, 2, 3, 4, 5, 6} and set(run(before=1707400035)) == {1, 2} and set(run(after=1707400045)) == {4, 5, 6} and set(run(before=1707400055, after=1707400025)) == {2, 3, 4}
    assert set(run(project="other")) == {5} and set(run(obs_type="command", order_by="blended")) == {3}
    with pytest.raises(ValueError, match="relevance or blended"):
        run(order_by="newest")


def test_tiered_episodes(spark, t):
    w = spark.createDataFrame([("sess-a", 1, 1, "the login work", None, 1, 1), ("sess-a", 2, 2, "other things", "of a session", 2, 2)], "session_id string, episode long, started_at long, intent string, summary string, first_prompt_id long, last_prompt_id long")
    index = search.build(t.observations, "id", "content")
    find = lambda q: [(r.episode, r.tier) for r in search.episodes_tiered(index, t.observations, w, q).collect()]
    assert find("cargo tests") == [(1, 0)] and find("cargo token") == [(1, 2)] and find("tok") == [(1, 1)] and find("SESSION") == [(2, 2)] and find("of") == [(2, 0)] and find("nothing") == []


def test_search_reports(spark):
    corpus = spark.createDataFrame([(i, x, NOW - i * 86400, "file_edit" if i % 2 else "command") for i, x in enumerate(TEXTS)], "id long, x string, ts long, kind string")
    index = search.build(corpus, "id", "x")
    assert ids(search.relevance(index, corpus, "id", "quick", 2)) == ids(search.relevance(index, corpus, "id", "quick", 9))[:2]
    assert search.relevance(index, corpus, "id", " ").collect() == []
    best = search.blended(index, corpus, "id", "bread", as_of=NOW, timestamp="ts", kind="kind").collect()
    assert [r.id for r in best] == [3] and best[0].score == round(0.5 + 0.3 * 2 ** (-3 / 7) + 0.2, 6)
    assert {r.tier for r in search.tiered(index, "quick bread").collect()} == {2} and {r.tier for r in search.tiered(index, "brown quick").collect()} == {0}
    assert search.missing_postings(index, corpus, "id", "x").count() == 0
    w = spark.createDataFrame([("s", 1, 5, "Summarization of 100%", None), ("s", 2, 6, "x", "y")], "session_id string, episode long, started_at long, intent string, summary string")
    assert [r.episode for r in search.episodes_like(w, "summarization").collect()] == [1] and [r.episode for r in search.episodes_like(w, "0%").collect()] == [1] and search.episodes_like(w, "_").collect() == []


def test_sweep(spark):
    day = 86400
    rows = [
        {"id": 1, "session_id": "a", "timestamp": NOW - 200 * day, "obs_type": "file_read"},
        {"id": 2, "session_id": "a", "timestamp": NOW - 200 * day, "obs_type": "file_read", "is_pinned": True},
        {"id": 3, "session_id": "a", "timestamp": NOW - 900 * day, "obs_type": "marker"},
        {"id": 4, "session_id": "b", "timestamp": NOW - 200 * day, "obs_type": "file_read"},
        {"id": 5, "session_id": "a", "timestamp": NOW - 10 * day, "obs_type": "file_read"},
        {"id": 6, "session_id": "c", "timestamp": NOW - 200 * day, "obs_type": "file_read"},
    ]
    own = Tables(sessions=sessions(spark, [("a", "p", 0, 1, "{}"), ("b", "p", 0, 1, None), ("c", "p", 0, 1, "{}")]), prompts=prompts(spark, ["x"]).limit(0), observations=observations(spark, rows))
    after = lifecycle.sweep(own, as_of=NOW)
    assert sorted(ids(after.observations)) == [2, 3, 4, 5] and sorted(ids(after.sessions)) == ["a", "b"]
    assert [(r.obs_type, r.deleted) for r in lifecycle.swept_by_type(own, as_of=NOW).collect()] == [("file_read", 2)]
    assert lifecycle.expired(own, as_of=NOW, days={}).collect() == []


def test_purge_and_pins(t):
    m = lifecycle.purge_matches(t, as_of=NOW, project="myproj", obs_type="file_edit")
    assert sorted(ids(m)) == [2, 6]
    assert sorted(ids(lifecycle.purge(t, m).observations)) == [1, 3, 4, 5]
    assert ids(lifecycle.purge(t, lifecycle.purge_matches(t, as_of=NOW, session="sess-b")).sessions) == ["sess-a"]
    with pytest.raises(ValueError):
        lifecycle.purge_matches(t, as_of=NOW)
    with pytest.raises(ValueError, match="not a date"):
        lifecycle.purge_matches(t, as_of=NOW, before="2024-02-30")
    assert sorted(ids(lifecycle.purge_matches(t, as_of=NOW, before="2024-02-08", older_than_days=1))) == []
    gone = lifecycle.delete_sessions(t, t.sessions.where("id = 'sess-a'"))
    assert (gone.observations.count(), gone.prompts.count(), gone.sessions.count()) == (1, 0, 1)
    assert ids(lifecycle.pin(t, 3).observations.where("is_pinned")) == [3]
    with pytest.raises(ValueError):
        lifecycle.pin(t, 77)
    marked = lifecycle.mark(t, "note", "myproj", as_of=NOW)
    assert marked.observations.where("obs_type = 'marker'").first().session_id == "sess-a" and marked.sessions.count() == 2
    assert lifecycle.mark(t, "note", "new", as_of=NOW).sessions.where(f"id = 'mark-{NOW}'").count() == 1
    assert lifecycle.append_new(t.sessions, t.sessions, ["id"]).count() == 2


def test_tasks(spark):
    rows = [(1, 5, "pending", None, None), (2, 4, "pending", 200, None), (3, 3, "pending", 50, None), (4, 1, "running", None, "a"), (5, 1, "running", None, "b"), (6, 9, "pending", None, None)]
    tasks = spark.createDataFrame([(i, c, s, None, None, None, p, None, None, None, r, None) for i, c, s, r, p in rows], model.TASKS)
    alive = spark.createDataFrame([("a",)], "tmux_target string")
    assert ids(lifecycle.eligible_tasks(tasks, as_of=100, most=3)) == [3] and ids(lifecycle.eligible_tasks(tasks, as_of=100, most=3, alive=alive)) == [3, 1]
    assert {r.id: r.status for r in lifecycle.reap(tasks, alive, as_of=100).collect()}[5] == "completed"
    assert lifecycle.task(tasks, 2).first().state == "scheduled"


def test_context(spark, t):
    w = spark.createDataFrame([("sess-a", 1, 1707400010, 1707400060, "ok", 1, 1, ["/src/auth.rs"], (0, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0), 5, '{"next_steps":["b","c"],"learned":["one","two"]}', None), ("sess-a", 2, 1707400070, 1707400080, "nothing was done here", 2, 2, [], (0,) * 11, 0, None, None)], model.WORK_UNITS)
    s = sessions(spark, [("sess-a", "myproj", 1707400000, 1, '{"intent":"repair the login","next_steps":["a","b"]}'), ("old", "myproj", 1700000000, 1, '{"intent":"older work"}'), ("sess-b", "other", 1707400100, 1, None)])
    own = replace(t, work_units=w, sessions=s)
    now = 1707400200
    (e,) = context.recent_episodes(own, "myproj", as_of=now).collect()
    assert (e.title, e.label, e.obs_count) == ("repair the login", "execute+failures", 5)
    assert context.recent_episodes(own, "myproj", as_of=now + 49 * 3600).collect() == []
    assert ids(context.fallback_summaries(own, "myproj", as_of=now)) == ["old"]
    assert [r.task for r in context.suggested_tasks(own, "myproj").collect()] == ["a", "b", "c"]
    assert [r.task for r in context.suggested_tasks(own, "myproj", as_of=1707400005).collect()] == ["a", "b"]
    assert ids(context.local_activity(own, "myproj", as_of=now)) == [6, 2]
    pinned = lifecycle.pin(own, 5)
    assert ids(context.cross_project_pins(pinned, "myproj", as_of=now)) == [5]
    text = context.render(pinned, "myproj", as_of=now)
    assert "## Recent Episodes" in text and "- /src/auth.rs — 2 edits (2m ago)" in text and "  learned: one; two" in text and "(pinned)" in text
    assert context.render(own, "none", as_of=now) == ""


def test_code_history(spark):
    rows = [(f"c{i}", f, 1000 + i, "a", "Revert x" if i == 2 else "rollback y" if i == 3 else "m", 2, 1) for i in range(4) for f in (["a.txt", "b.txt"] if i < 3 else ["a.txt"])]
    commits = spark.createDataFrame(rows, model.COMMITS)
    a = code_history.churn(commits).where("file = 'a.txt'").first()
    assert (a.commits, a.insertions, a.reverts, a.first_ts) == (4, 8, 2, 1000)
    assert [(r.file, r.times) for r in code_history.co_changes(commits, "a.txt").collect()] == [("b.txt", 3)]
    assert "4 commits" in code_history.dense_summary(code_history.churn(commits)).where("file = 'a.txt'").first().summary
    hunks = spark.createDataFrame([("f", 1, 3, "x"), ("f", 4, 2, "y")], "file string, start long, count long, commit string")
    lines = spark.createDataFrame([("f", 3), ("f", 4), ("f", 9)], "file string, line long")
    assert {r.line: r.commit for r in code_history.blame(hunks, lines).collect()} == {3: "x", 4: "y", 9: None}


def test_modules(spark):
    files = spark.createDataFrame([("src/a.rs", "use crate::b;\nuse crate::zzz;\n// use crate::c\npub fn f() {}\npub struct S;\n"), ("k/src/b.rs", "pub async fn g() {}"), ("src/c.rs", "")], "path string, text string")
    from tracelake.sources.hooks import rust_modules

    m, u = rust_modules(files)
    r = {x.module: x for x in code_history.module_roles(m, u).collect()}
    assert (r["src/a"].role, r["src/a"].lines, r["src/a"].items, r["k/b"].role, r["src/c"].role, r["k/b"].in_degree) == ("leaf", 5, 2, "foundation", "isolated", 1)
    assert 'role = "leaf"' in sinks.module_map(code_history.module_roles(m, u)) and code_history.rankings(code_history.module_roles(m, u)).count() == 9


def test_timeouts(spark):
    def rto(*rtts):
        return spark.createDataFrame([(list(rtts),)], "r array<double>").select(fleet.estimate(F.col("r"))).first()[0]

    assert rto() == 3.0 and rto(0.1) == pytest.approx(0.3) and 0.09 < rto(*[0.1] * 50) < 0.15 and rto(0.2) == pytest.approx(0.6) and rto(*[0.001] * 60) == 0.05
    assert rto(0.1, None) == pytest.approx(0.4) and rto(0.1, None, None) == pytest.approx(0.6)
    v = spark.createDataFrame([(i, 5, 5 if i % 2 else 4) for i in range(10)], "claim long, n long, k long")
    row = fleet.ensemble_quality(v).first()
    assert (row.agreement, row.majority_right) == (0.9, 0.99144)


def test_timeouts_of_many(spark):
    """The fold of rounds in order against the estimate of an array; one instance has most rounds, one no answers, one no name."""
    rng = random.Random(4)
    rows = [(k, i, None if rng.random() < 0.1 else rng.random()) for k, n in (("hot", 2000), ("b", 7), (None, 5), ("one", 1)) for i in range(n)] + [("silent", 1, None)]
    of = {}
    for k, i, r in rows:
        of.setdefault(k, []).append(r)
    want = {r.k: (r.n, r.rto) for r in spark.createDataFrame(list(of.items()), "k string, r array<double>").select("k", F.size("r").alias("n"), F.round(fleet.estimate(F.col("r")), 6).alias("rto")).collect()}
    rng.shuffle(rows)
    got = fleet.timeouts(spark.createDataFrame(rows, "k string, round long, rtt double"), "k").collect()
    assert {r.k: (r.rounds, pytest.approx(r.rto)) for r in got} == want and len(got) == 5


def test_models(spark):
    part = {"vocabulary": {"fix": 0, "bug": 1}, "idf": [1.5, 2.0], "weights": [-0.5, -0.3], "ngram_range": [1, 1], "binary": True, "sublinear_tf": False}
    none = {"vocabulary": {}, "idf": [], "weights": [], "ngram_range": [3, 5], "binary": False, "sublinear_tf": True}
    assert classify.part_score(part, classify.word_grams("Fix the bug", 1, 1)) == pytest.approx(-0.54)
    m = {"classes": ["a", "b"], "word": part, "char": none, "bias": 0.5}
    label, sure = classify.predict(m, "")
    assert label == "b" and sure > 0.5 and len(classify.fingerprint(m)) == 16
    assert classify.char_grams("ab", 3, 3) == {" ab": 1, "ab ": 1} and classify.char_grams("ab", 5, 5) == {}
    rows = [(f"{'good fine nice' if i % 2 else 'bad awful poor'} text {i % 5}", "good" if i % 2 else "poor") for i in range(60)]
    model_ = classify.train(spark.createDataFrame(rows, "text string, label string"), "text", "label", ("poor", "good"))
    assert classify.predict(model_, "nice and good")[0] == "good" and classify.predict(model_, "awful")[0] == "poor"
    assert model_["char"]["vocabulary"] and "accuracy" not in model_
    mixed = [(f"{' '.join(('red', 'blue', 'green')[(i * j) % 3] for j in range(4))} {'bad' if i % 3 else 'good'}ness {i % 7}", "poor" if i % 3 else "good") for i in range(120)]
    frame = spark.createDataFrame(mixed, "text string, label string")
    checked = classify.train(frame, "text", "label", ("poor", "good"), folds=5)
    assert checked["accuracy"] > 0.95 and classify.train(frame.limit(0), "text", "label", ("poor", "good"))["bias"] == 0
    none_yet = spark.createDataFrame([], "id long, name string, model_hash string, accuracy double, created_at long")
    runs, first = classify.register_run(none_yet, "phase", checked, as_of=5)
    again, second = classify.register_run(runs, "phase", checked, as_of=6)
    other, third = classify.register_run(again, "scope", checked, as_of=7)
    assert (first, second, third, other.count(), other.agg(F.max("accuracy")).first()[0]) == (1, 1, 2, 2, checked["accuracy"])
    obs = observations(spark, [{"id": 1, "content": "fix bug"}, {"id": 2, "content": "x", "phase": "keep"}])
    assert {r.id: r.phase for r in classify.backfill(obs, {"phase": m}).collect()} == {1: "a", 2: "keep"}
    pairs = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "expected string, predicted string")
    got = {r["class"]: r for r in classify.measures(pairs).collect()}
    assert (got["x"].precision, got["x"].recall, got["y"].recall, got["y"].accuracy) == (1.0, 0.5, 1.0, 0.75)
    assert classify.balanced(pairs, "predicted").groupBy("predicted").count().select(F.max("count")).first()[0] == 1
    q = classify.summary_quality(spark.createDataFrame([('{"intent":"a b","learned":["x"],"completed":"no","notes":null}',), ("nope",)], "summary string")).collect()
    assert (q[0].fields_present, q[0].array_compliance, q[0].intent_words, q[0].learned_count, q[0].notes_present, q[1].json_valid) == (4, 1, 2, 1, False, False)


def test_payloads(t):
    p = episodes.payload(t)
    s = episodes.template_summary(p).collect()
    assert [x.session_id for x in s] == ["sess-a"] and json.loads(s[0].summary)["files_edited"] == ["/src/auth.rs"]
    lenient = t.sessions.sparkSession.createDataFrame([('{"intent":"i","learned":"one","completed":["a","b"]}',)], "s string").select(episodes.lenient_summary(F.col("s")).alias("x")).first().x
    assert (lenient.learned, lenient.completed, lenient.next_steps) == (["one"], ["a", "b"], [])
    done = replace(t, sessions=t.sessions.withColumn("ended_at", F.lit(1)))
    assert {r.id: r.action for r in episodes.catch_up(done).collect()} == {"sess-a": "summarise", "sess-b": "sentinel"}
