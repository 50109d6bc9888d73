"""Secret scans (10): regex candidates, and corpus-wide ownership frequency to add live-looking ones.

Only DataFrame functions. Base spans come from three patterns. The method adds bare tokens (20 or more characters with
lower-case, upper-case and digit, outside base spans) whose hash few owners share: aggregated by distinct repositories
and owners, a token of more than MAX_OWNERS owners or MAX_REPOS repositories is a widely copied example, the rest are
owner-specific. Counts are by partial sums, so a token in a third of all documents gathers nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import broadcast_if_small, checkpoint, columns, read, row_key

KINDS = ("assign", "access", "hex", "bare")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 8
#: A maximal run of [0-9a-f]+ of 32 or more is what this matches; so for the access key, of 16 or more.
ACCESS, HEX, BARE = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}", "[A-Za-z0-9+/_=-]{20,}"
MAX_OWNERS, MAX_REPOS = 2, 3


def matches(text: Column, kind: int, pattern: str, group: int, maybe: Column) -> Column:
    """An array of each match's kind, index, characters before it since the last, length, and its value's length and hashes."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
        F.split(text, pattern, -1).alias("b"),
    )
    each = F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.char_length(x["b"]).alias("gap"),
            F.char_length(x["m"]).alias("len"),
            (F.char_length(x["v"]) >= (ASSIGN_LEAST if group else 0)).alias("ok"),
            (F.lit(kind < 3) | (x["v"].rlike("[0-9]") & x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]"))).alias("live"),
            F.xxhash64(x["v"]).alias("h1"),
            F.xxhash64(F.lit(1), x["v"]).alias("h2"),
        ),
    )
    return F.when(maybe & text.rlike(pattern), F.filter(each, lambda x: x["len"].isNotNull()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_bare, n_copied, base, spans``: every row, spans as ``kind:start:end`` lists.

    n_copied counts the spans whose value is a widely copied example; base ones stay even so. Null and empty texts have no
    spans. A null owner or repository counts as none, so a token known only from such rows counts as owner-specific.
    Repeated rows are all returned, alike, and count once for frequency. An empty table gives an empty result; other
    columns are not read.
    """
    d = columns(docs, id=id_col, text=text_col, owner=owner_col, repo=repo_col)
    d = d.select("id", "text", "owner", F.col("repo").cast("string").alias("repo"), *row_key(d["id"], d["text"], d["owner"], d["repo"]))
    text, lower = F.col("text"), F.lower("text")
    named = reduce(lambda a, b: a | b, (lower.contains(x) for x in ("password", "passwd", "secret", "token", "apikey", "api_key")))
    kinds = [matches(text, 0, ASSIGN, 1, named), matches(text, 1, ACCESS, 0, text.contains("AKIA")), matches(text, 2, HEX, 0, F.lit(True)), matches(text, 3, BARE, 0, F.lit(True))]
    found = d.select("k1", "k2", "owner", "repo", F.explode(F.flatten(F.array_compact(F.array(*kinds)))).alias("x")).select("k1", "k2", "owner", "repo", "x.*")
    # Rows of one document only meet in these windows; a repeated row counts once.
    found = found.distinct()
    before = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    found = found.withColumn("start", F.col("end") - F.col("len")).where(F.col("ok") & F.col("live"))
    base = F.col("kind") < 3
    order = Window.partitionBy("k1", "k2").orderBy("start", "kind", "end")
    found = found.withColumn("upto", F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("k1", "k2").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    found = found.withColumn("next", F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.coalesce("upto", F.lit(0)) > F.col("start")) | (F.coalesce("next", F.col("end")) < F.col("end"))
    found = checkpoint(found.where(base | ~inside).select("k1", "k2", "owner", "repo", "kind", "start", "end", "h1", "h2"))

    copied = found.groupBy("h1", "h2").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    copied = checkpoint(copied.where((F.col("owners") > max_owners) | (F.col("repos") > max_repos)).select("h1", "h2", F.lit(True).alias("copied")))
    found = found.join(broadcast_if_small(copied, copied.count()), ["h1", "h2"], "left").where(base | F.col("copied").isNull())

    def listed(only: Column | None) -> Column:
        s = F.struct("start", "kind", "end")
        sorted_ = F.array_sort(F.collect_list(s if only is None else F.when(only, s)))
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(sorted_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(4)] + [F.count_if("copied").alias("n_copied")]
    per = found.groupBy("k1", "k2").agg(*counts, listed(base).alias("base"), listed(None).alias("spans"))
    out = d.select("id", "k1", "k2").join(per, ["k1", "k2"], "left")
    n = ["n_assign", "n_access", "n_hex", "n_bare", "n_copied"]
    return out.select(F.col("id").alias("doc_id"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in n], *[F.coalesce(x, F.lit("")).alias(x) for x in ("base", "spans")])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_bare", "n_copied")


SQL = None
