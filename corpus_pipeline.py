"""A training corpus from documents: language, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents but for
the last, which returns one row of placement for each document. Repeated ids after the mixture are wanted: a document
that is taken twice is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, lang_id, mixing, near_dedup, sharding
from tracelake.llm.common import discard, fresh, read, stored, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no known language, by text, declared language and source."""
    model = lang_id.train(docs)
    found = lang_id.identify_documents(docs, model)
    rejected = found.where(F.col("lang") == lang_id.UNKNOWN).select("k1", "k2").distinct()
    # The operator's key is of id, text, declared language, host and suffix; documents have no suffix.
    declared, host, suffix = fresh(docs, "declared", "host", "suffix")
    rows = docs.select("*", docs["lang"].cast("string").alias(declared), docs["source"].cast("string").alias(host), F.lit(None).cast("string").alias(suffix))
    return without(rows, rejected, "doc_id", "text", declared, host, suffix).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more. Pairs come from SimHash
    fingerprints by pigeonring, and by prefixes where these miss some; each is checked exactly."""
    return near_dedup.keep_one(docs, groups_of=near_dedup.fingerprinted_groups)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate.find_contaminated(docs, read(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0").select("k1", "k2").distinct(), "doc_id", "text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents are there 0, 1 or 2 times."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir))
        discard(docs)  # what a stage has read is not needed once its result is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints by XXH64, trigram models and components are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
