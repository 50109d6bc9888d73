"""Helpers that the operators of this subpackage share: reliable cuts of lineage, bounded broadcasts, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.reliable import checkpoint, folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
#: A broadcast side may have this many rows at most, or this many of two or three longs; beyond it the join shuffles.
BROADCAST_ROWS, KEYS = 200_000, 1_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other alphabets)."""
    return F.translate(text, UPPER, UPPER.lower())


#: Names of the tables that this process has stored.
_MADE: set[str] = set()


def stored(df: DataFrame) -> DataFrame:
    """``df``, written as a table in the reliable folder and read again: smaller than a checkpoint for long texts, and read by column."""
    name = f"stored-{uuid.uuid4().hex}"
    _MADE.add(name)
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of tables that ``stored`` has made and ``df`` reads, once nothing needs them any more; no others."""
    jvm = df.sparkSession._jvm
    for folder_ in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if (name := folder_.rpartition("/")[2]) in _MADE:
            path = jvm.org.apache.hadoop.fs.Path(folder_)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            _MADE.discard(name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that ``df`` doesn't have."""
    out = []
    for name in names:
        while name.lower() in {x.lower() for x in [*df.columns, *out]}:
            name = f"_{name}"
        out.append(name)
    return out


def keyed(df: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the two hashes of ``cols``, and their names."""
    names = fresh(df, "k1", "k2")
    return df.select("*", *[k.alias(n) for k, n in zip(row_key(*[df[f"`{c}`"] for c in cols]), names)]), names


def without(df: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """The rows of ``df`` whose hashes of ``cols`` aren't among ``keys`` (k1, k2): with a broadcast of these if they are few."""
    rows, names = keyed(df, *cols)
    keys = checkpoint(keys.select(*[F.col(k).alias(n) for k, n in zip(("k1", "k2"), names)]))
    keys = broadcast_if_small(keys, keys.count(), KEYS)
    return rows.join(keys, names, "left_anti").select(*df.columns)


def broadcast_if_small(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """A broadcast hint if ``rows``, a counted figure, is within the bound (BROADCAST_ROWS); else ``df``, for a shuffled join.

    ``df`` should be kept already: then both sides of a shuffled join are plain exchanges, which adaptive execution can split.
    """
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the needed columns of ``df``, under the operator's own names, so that other columns can't clash with them."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in named.items()])


def row_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of a row's columns (nulls told apart): equal rows have equal keys."""
    return [F.xxhash64(F.lit(seed), *[x for c in cols for x in (c.isNull(), c)]).alias(f"k{seed}") for seed in (1, 2)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
