"""Connected components of a table of links, by rounds of joins; no link or label goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import discard, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a long, b long) to (node, component): component is the smallest node that node reaches.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest neighbour, then
    each node hands its smaller ones to the smallest of these. The number of rounds grows with the logarithm of the
    longest path. Each round's links are written to the shared folder, and those before deleted; the result is a written table. Nodes without a link to another are left out;
    null ends are ignored. No links give no rows.
    """
    edges = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).join(least.withColumnRenamed("u", "x"), "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        large = written(large, "links")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u > v").distinct(), "links")
        discard(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stars = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0 and edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0
        if stars or now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(edges)
    return found
