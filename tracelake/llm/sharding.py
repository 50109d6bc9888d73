"""Sharding (6): weighted rendezvous hashing of stable record keys.

Each shard scores a key by -weight / ln(u), u a uniform hash of key and shard; the highest score has it. A shard more
takes rows only into itself, and a share of them by its weight. All of it is one projection without a shuffle; gapless
slots within shards come from counts by partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import columns, read
from tracelake.llm.numbering import numbered

SHARDS = 24


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a string key; of equal scores the lowest shard. Weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        scores.append(F.struct((-float(weight) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.greatest(*scores)["shard"]).cast("int")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard``: the shard of every row, its slot there, its shard with one more.

    The id decides, so repeated rows are in one shard, each with its own slot; a null id has its own key. A null text has
    size 8 and the checksum of an empty one. An empty table gives an empty result; other columns are not read.
    """
    d = columns(docs, id=id_col, text=text_col)
    key = F.coalesce(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = d.select(
        F.col("id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, added]).alias("grown_shard"),
    )
    return numbered(rows, ["shard"], ["doc_id", "text_crc32"], "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: SQL can't tell the slots, which are any gapless numbers; tests hold the shards against plain Python.
SQL = None
