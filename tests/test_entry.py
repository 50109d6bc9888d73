"""The entry module: with and without its optional parts, and its queries against their SQL."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tracelake.plans import registry

ROOT, DIR = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["id", "session_id", "obs_type", "content", "score"]
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_optional_parts(tmp_path):
    """A copy without the subpackage and the pipeline imports and has the library's queries."""
    import shutil

    shutil.copytree(ROOT / "tracelake", tmp_path / "tracelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [x for x in q if x.startswith('op') or x == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert sorted(names) == cols and sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
