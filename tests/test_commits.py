"""The order of commits against a plain walk, and changes against first parents against plain Python."""

import heapq
import random

import pytest

from tracelake.operators import code_history
from tracelake.functions import reliable
from tracelake.sources import driver_tables


def plain(commits, parents):
    """A walk with a heap over one repository: commits (id, time), parents (id, parent)."""
    time = dict(commits)
    edges = {(c, p) for c, p in parents if c in time and p in time}
    waiting = {c: sum(p == c for _, p in edges) for c in time}
    ready = [(-time[c], -c) for c in time if not waiting[c]]
    heapq.heapify(ready)
    out = []
    while ready:
        c = -heapq.heappop(ready)[1]
        out.append(c)
        for x, p in edges:
            if x == c:
                waiting[p] -= 1
                if not waiting[p]:
                    heapq.heappush(ready, (-time[p], -p))
    return out


def test_commit_order(spark):
    rng = random.Random(3)
    commits, parents, want = [], [], {}
    for repo in range(12):
        c, p = [], []
        for i in range(rng.randint(1, 40)):
            # Half of the repositories have clocks that go wrong, and many equal times.
            t = i // 3 if repo % 2 else (rng.randrange(10) if rng.random() < 0.3 else i)
            c.append((i, t))
            p += [(i, rng.randrange(i)) for _ in range(rng.choice([1, 1, 2, 3]))] if i else []
        p.append((0, 99))  # a shallow copy: not there
        commits += [(repo, *x) for x in c]
        parents += [(repo, *x) for x in p]
        want[repo] = plain(c, p)
    rng.shuffle(commits)
    got = code_history.commit_order(spark.createDataFrame(commits, "repo long, commit long, timestamp long"), spark.createDataFrame(parents, "repo long, commit long, parent long")).collect()
    for repo, order in want.items():
        assert [r.commit for r in sorted((r for r in got if r.repo == repo), key=lambda r: r.position)] == order
    assert len(got) == len(commits)


def test_a_circle_is_an_error(spark):
    c = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "repo long, commit long, timestamp long")
    p = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "repo long, commit long, parent long")
    with pytest.raises(Exception, match="circle"):
        code_history.commit_order(c, p).collect()


def test_first_parent_changes(spark):
    rng = random.Random(5)
    tree = {c: {f"f{i}": rng.randrange(3) for i in range(8) if rng.random() < 0.6} for c in range(1, 12)}
    tree[7] = {}
    first = {c: c - 1 for c in range(2, 12)} | {9: 3, 11: 50}
    parents = [("r", c, p, 0) for c, p in first.items()] + [("r", c, 1, 1) for c in (5, 6)]
    want = set()
    for c, own in tree.items():
        old = tree.get(first.get(c), {})
        want |= {(c, f, "added" if f not in old else "deleted" if f not in own else "modified") for f in own.keys() | old.keys() if own.get(f) != old.get(f)}
    trees = spark.createDataFrame([("r", c, f, b) for c, own in tree.items() for f, b in own.items()], "repo string, commit long, path string, blob long")
    got = code_history.first_parent_changes(trees, spark.createDataFrame(parents, "repo string, commit long, parent long, place int"))
    assert sorted((r.commit, r.path, r.change) for r in got.collect()) == sorted(want) and len(want) > 30


def test_commits_are_dealt_out_by_their_number(spark, monkeypatch):
    """Lines and orders meet in as many partitions as their number asks for, not in a fixed number."""
    monkeypatch.setattr(reliable, "DEALT", 50)
    made = driver_tables.commits(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 50


def test_summaries_of_churn_do_not_depend_on_partitions(spark, monkeypatch):
    plain = sorted(map(tuple, code_history.dense_summary(code_history.churn(driver_tables.commits(spark, "/root/testdata/sf0.001"))).collect()))
    monkeypatch.setattr(reliable, "DEALT", 300)
    made = code_history.dense_summary(code_history.churn(driver_tables.commits(spark, "/root/testdata/sf0.001")))
    assert sorted(map(tuple, made.collect())) == plain and "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_blame_of_many_hunks(spark, monkeypatch):
    """Against a plain search, with hunks that repeat, have no commit, or reach over blocks; dealt out by their number."""
    monkeypatch.setattr(reliable, "DEALT", 20)
    rng = random.Random(5)
    hunks = [(rng.choice("ab"), rng.randrange(40), rng.randrange(-1, 9), rng.choice(["x", "y", "z", None])) for _ in range(200)] + [("a", 3, 90, "long")]
    h = spark.createDataFrame(hunks, "file string, start bigint, count bigint, commit string")
    lines = code_history.lines_of(h, after=1)
    want = {(f, i) for f, s, n, _ in hunks for i in range(s, s + n + 1)}
    assert sorted(map(tuple, lines.collect())) == sorted(want)
    first = lambda f, i: min(((s, n, c or "") for g, s, n, c in hunks if g == f and s <= i < s + n), default=None)
    made = code_history.blame(h, lines, block=16)
    assert {(r.file, r.line): (r.commit or "", r.offset) for r in made.collect()} == {(f, i): ((x[2], i - x[0]) if (x := first(f, i)) else ("", None)) for f, i in want}
    assert "hashpartitioning(file" in (plan := made._jdf.queryExecution().executedPlan().toString()) and f", {sum(n > 0 for _, _, n, _ in hunks) // 20 + 1}), REPARTITION_BY_NUM" in plan
