"""Line dedup (7): explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Only DataFrame functions. Two shuffles of narrow rows (line hash, document) and one of the texts. A line of a third of
all documents is counted by partial sums and meets its verdict in a join that adaptive execution can split, as both of its
sides are plain exchanges; the few verdicts are broadcast only when their counted number is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import BLANKS, broadcast_if_small, checkpoint, columns, lower_ascii, read, row_key

MIN_CHARS, MIN_DOCS = 20, 3


def drop_positions(lines: Column, dropped: Column) -> Column:
    """``lines`` without those at the sorted 0-based positions ``dropped``; in time linear in both."""
    kept = F.transform(
        F.sequence(F.lit(0), F.size(dropped)),
        lambda i: F.slice(
            lines,
            F.when(i == 0, 1).otherwise(F.get(dropped, i - 1) + 2),
            F.coalesce(F.get(dropped, i), F.size(lines)) - F.when(i == 0, 0).otherwise(F.get(dropped, i - 1) + 1),
        ),
    )
    return F.flatten(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: every row, without lines whose key is in ``min_docs`` or more documents.

    The largest id that holds a line keeps it. A null or empty text is one empty line. Rows of the same id count as one
    document; null ids together are one document, the smallest. Repeated rows all stay and are treated alike. An empty
    table gives an empty result; other columns are not read.
    """
    d = columns(docs, id=id_col, text=text_col)
    d = d.select("id", F.coalesce("text", F.lit("")).alias("text"), *row_key(d["id"], F.coalesce(d["text"], F.lit(""))))
    key = F.transform(F.split(lower_ascii(F.col("text")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashed = F.transform(key, lambda x, i: F.when(F.char_length(x) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))))
    # Kept as three arrays a row, which takes 20 bytes a line.
    lines = d.select("id", "k1", "k2", F.filter(hashed, lambda x: x.isNotNull()).alias("line"))
    lines = checkpoint(lines.select("id", "k1", "k2", "line.pos", "line.h1", "line.h2"))
    lines = lines.select("id", "k1", "k2", F.explode(F.arrays_zip("pos", "h1", "h2")).alias("line")).select("id", "k1", "k2", "line.*")
    # One row for each hash and document, then partial sums: no task gathers the documents of a hash.
    verdict = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    verdict = checkpoint(verdict.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    hits = lines.join(broadcast_if_small(verdict, verdict.count()), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    # Repeated rows share a key: their positions come once for each copy, hence the set.
    dropped = checkpoint(hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("dropped")))
    lines_of = F.split("text", "\n", -1)
    out = d.join(dropped, ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(drop_positions(lines_of, F.col("dropped")), "\n")).alias("text"),
        F.size(lines_of).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
verdict AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, v.key IS NOT NULL AND k.doc_id <> v.keeper AS dropped FROM keyed k LEFT JOIN verdict v USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
