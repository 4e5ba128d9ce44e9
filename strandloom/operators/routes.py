"""Where filtered pairs go, and the counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routed(pairs: DataFrame) -> DataFrame:
    """Pairs with good1, good2 (not discarded) and bad1, bad2 (contaminated): adds route, null for pairs that go nowhere.

    Both good: "paired", or nowhere if either is contaminated. One good: "unpaired" if it isn't contaminated."""
    c = F.col
    one = F.when(c("good1"), ~c("bad1")).otherwise(~c("bad2"))
    route = F.when(c("good1") & c("good2"), F.when(~(c("bad1") | c("bad2")), "paired")).when(c("good1") | c("good2"), F.when(one, "unpaired"))
    return pairs.withColumn("route", route)


def counters(pairs: DataFrame) -> DataFrame:
    """One row: reads in all, passed, of low quality, contaminated, and the length of those that passed (length1, length2 of the good parts)."""
    c = F.col
    good = c("good1").cast("int") + c("good2").cast("int")
    passed = F.when(c("route") == "paired", 2).when(c("route") == "unpaired", 1).otherwise(0)
    length = F.when(c("route") == "paired", c("length1") + c("length2")).when(c("route") == "unpaired", F.when(c("good1"), c("length1")).otherwise(c("length2"))).otherwise(0)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return routed(pairs).agg((F.count("*") * 2).alias("total"), total(passed).alias("passed"), total(2 - good).alias("low_quality"), total(good - passed).alias("contaminated"), total(length).alias("total_length"))
