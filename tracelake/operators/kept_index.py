"""A search index that is kept as documents come and go: segments of postings, and the documents that were removed since.

What is added becomes a new segment, for which only new documents are tokenised. What is removed is noted beside the
segments; a note holds for segments older than itself, so that a document may come again. Segments are merged while they
are small, and all is rewritten once much of it is removed. ``versions`` has a line for each change; readers take the one
with the highest number, so that a change that fails on its way leaves what was there before. One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.reliable import delete
from tracelake.operators import search

#: Removed documents that may be broadcast; the share of them at which an index is rewritten.
BROADCAST, REWRITE = 200_000, 0.3
#: A segment is merged with smaller ones that have together at least this part of its documents.
PART = 4
#: A posting with this term tells that a document is there, and its length.
PRESENT = ""


@dataclass(frozen=True)
class State:
    """A version: its segments and notes of removal by number with their documents; documents and words that are there."""

    version: int
    stemmed: bool
    buckets: int
    kind: str  # of document ids
    segments: dict[str, int]
    removed: dict[str, int]
    n: int = 0
    words: int = 0

    @property
    def next(self) -> int:
        return self.version + 1


def state(spark: SparkSession, path: str) -> State:
    rows = spark.read.text(f"{path}/versions").collect()  # a line for each change of the index
    return max((State(**json.loads(r.value)) for r in rows), key=lambda s: s.version)


def _commit(spark: SparkSession, path: str, s: State) -> State:
    s = replace(s, version=s.next)
    spark.createDataFrame([(json.dumps(asdict(s)),)], "value string").coalesce(1).write.mode("append").text(f"{path}/versions")
    return s


def create(spark: SparkSession, path: str, stemmed: bool = True, buckets: int = search.BUCKETS, kind: str = "bigint") -> State:
    """An empty index; ``kind`` is the type of the documents' ids."""
    return _commit(spark, path, State(-1, stemmed, buckets, kind, {}, {}))


def _alive(spark: SparkSession, path: str, s: State, segments: list[str] | None = None) -> DataFrame:
    """``segment, bucket, term, doc, positions, dl`` of documents that are there."""
    segments = list(s.segments) if segments is None else segments
    schema = f"term string, doc {s.kind}, positions array<int>, dl int, segment int, bucket int"
    if not segments:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/postings").where(F.col("segment").isin([int(x) for x in segments]))
    if not s.removed:
        return rows
    gone = spark.read.schema(f"doc {s.kind}, number int").parquet(f"{path}/removed").where(F.col("number").isin([int(x) for x in s.removed]))
    gone = gone.groupBy("doc").agg(F.max("number").alias("number"))
    gone = F.broadcast(gone) if sum(s.removed.values()) <= BROADCAST else gone
    return rows.join(gone, "doc", "left").where(F.col("number").isNull() | (F.col("number") < F.col("segment"))).drop("number")


def _present(spark: SparkSession, path: str, s: State) -> DataFrame:
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(PRESENT)), F.lit(s.buckets)).cast("int")).first()[0]
    return _alive(spark, path, s).where((F.col("bucket") == bucket) & (F.col("term") == PRESENT)).select("doc", "dl")


def load(spark: SparkSession, path: str) -> search.Index:
    """The newest version, for the searches of ``search``."""
    s = state(spark, path)
    rows = _alive(spark, path, s).where(F.col("term") != PRESENT).select("bucket", "term", "doc", "positions", "dl")
    return search.Index(None, s.stemmed, rows, s.n, s.words / s.n if s.n else 0.0, s.buckets)


def _write(rows: DataFrame, path: str, s: State) -> tuple[int, int]:
    """A segment's documents and words; what an earlier try has left under its number is replaced."""
    search.by_bucket(rows).write.mode("overwrite").partitionBy("bucket").parquet(to := f"{path}/postings/segment={s.next}")
    marks = rows.sparkSession.read.schema("term string, dl int").parquet(to).where(F.col("term") == PRESENT)
    return tuple(marks.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())


def add(spark: SparkSession, path: str, corpus: DataFrame, id_col: str, text_col: str) -> int:
    """Adds the documents that aren't there yet, and returns how many they were. Null ids are left out; ids are unique."""
    s = state(spark, path)
    new = corpus.select(F.col(id_col).cast(s.kind).alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull())
    if s.segments:
        new = new.join(_present(spark, path, s).select("doc"), "doc", "left_anti")
    words = new.select("doc", search.tokens(F.col("text"), s.stemmed).alias("tokens"))
    # The mark of presence is a last token, so that texts are tokenised once.
    rows = search.postings_of(words, PRESENT)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(s.buckets)).cast("int"))
    n, words = _write(rows, path, s)
    if n:
        _commit(spark, path, replace(s, segments=s.segments | {str(s.next): n}, n=s.n + n, words=s.words + words))
    return n


def remove(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc", rewrite: float = REWRITE) -> int:
    """Removes documents, and returns how many of them were there; rewrites the index once ``rewrite`` of it is removed ones."""
    s = state(spark, path)
    gone = _present(spark, path, s).join(ids.select(F.col(id_col).cast(s.kind).alias("doc")).distinct(), "doc", "left_semi")
    gone.write.mode("overwrite").parquet(to := f"{path}/removed/number={s.next}")
    n, words = spark.read.parquet(to).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if n:
        s = _commit(spark, path, replace(s, removed=s.removed | {str(s.next): n}, n=s.n - n, words=s.words - words))
        if sum(s.removed.values()) >= rewrite * sum(s.segments.values()):
            rebuild(spark, path)
    return n


def _joined(spark: SparkSession, path: str, s: State, segments: list[str]) -> State:
    """One segment for several, without removed documents, from their postings: nothing is tokenised."""
    n, _ = _write(_alive(spark, path, s, segments).drop("segment"), path, s)
    kept = {k: v for k, v in s.segments.items() if k not in segments}
    older = min(map(int, kept), default=s.next)
    return _commit(spark, path, replace(s, segments=kept | ({str(s.next): n} if n else {}), removed={k: v for k, v in s.removed.items() if int(k) > older}))


def rebuild(spark: SparkSession, path: str) -> State:
    """All in one segment, without what was removed."""
    s = state(spark, path)
    return _joined(spark, path, s, list(s.segments)) if s.segments else s


def merge(spark: SparkSession, path: str) -> State:
    """Merges the smallest segments while each next one has at most PART times the documents of those before it; so a document
    is rewritten a number of times that grows with the logarithm of their number."""
    s = state(spark, path)
    taken, total = [], 0
    for k, n in sorted(s.segments.items(), key=lambda x: (x[1], int(x[0]))):
        if taken and n > PART * total:
            break
        taken.append(k)
        total += n
    return _joined(spark, path, s, taken) if len(taken) > 1 else s


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the files of segments and notes that the newest version doesn't need, once no reader of older ones is left."""
    s, jvm = state(spark, path), spark._jvm
    gone = 0
    for folder, kept in ((f"{path}/postings", s.segments), (f"{path}/removed", s.removed)):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for f in fs.listStatus(at) if fs.exists(at) else []:
            if f.getPath().getName().rpartition("=")[2] not in kept:
                gone += delete(spark, f.getPath().toString())
    return gone
