"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: str, order: list[str], blocks: int = 64) -> DataFrame:
    """Adds rank (from 0) within each value of `group`: rows are dealt to blocks by a hash of `order`, numbered within their block in that order, and moved on by the counts of the blocks before.

    No task has a whole group, and only counts go through the second window. Rows with equal `order` are ranked in any order."""
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy(group, "_block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order))
    return dealt.withColumn("_local", local).join(before, [group, "_block"]).withColumn("rank", F.col("_before") + F.col("_local") - 1).drop("_block", "_local", "_before")
