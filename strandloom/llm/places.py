"""Places of rows in a global order, without a task that has them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import partitions, written

_BITS = 33  # monotonically_increasing_id has the partition above these bits and the row's number in it below


def numbered(df: DataFrame, order: list[Column], name: str, counted: Column | None = None) -> tuple[DataFrame, int, int]:
    """df as a written table with `place`, the row's number (from 0) in `order`; then the number of rows, and of those where `counted` holds.

    Rows are dealt to partitions by ranges of `order` and, so that any number of equal ones can be split, of their number in df; each is sorted by its own task. The driver gets a count for each partition. Equal rows are placed in any order.
    df must be of the written kind or another that gives the same rows in the same partitions when a task runs again.
    """
    spark = df.sparkSession
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    keys = [*order, F.col("_salt")]
    dealt = salted.repartitionByRange(max(1, partitions(spark)), *keys).sortWithinPartitions(*keys).drop("_salt")
    table = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    held = F.count_if(counted) if counted is not None else F.count("*")
    parts = table.groupBy(F.shiftright("_at", _BITS).alias("_part")).agg(F.count("*").alias("n"), held.alias("m")).orderBy("_part").collect()  # a row for each partition
    before, total = [], 0
    for p in parts:
        before.append((p["_part"], total))
        total += p.n
    offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    placed = table.withColumn("_part", F.shiftright("_at", _BITS)).join(offsets, "_part").withColumn("place", F.col("_before") + local).drop("_part", "_before", "_at")
    placed._own_table = table._own_table
    return placed, total, sum(p.m for p in parts)
