"""Gapless numbers within groups without gathering a group: by partition of a kept table, plus offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import checkpoint


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each ``group`` (all rows if empty), in the order of partitions, then ``order``.

    The rows are kept reliably first, so that their partitions are the same whenever they are read again. A task numbers
    the rows of one partition and group; only the counts, one for each partition and group, are summed up along a group.
    """
    kept = checkpoint(df).withColumn("_part", F.spark_partition_id())
    counts = kept.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*group, "_part").orderBy(*order)
    rows = kept.withColumn("_row", F.row_number().over(here) - 1)
    on = [rows[g].eqNullSafe(offsets[f"_g_{g}"]) for g in group] + [rows["_part"] == offsets["_p"]]
    return rows.join(offsets, on).select(*df.columns, (F.col("_before") + F.col("_row")).cast("long").alias(name))
