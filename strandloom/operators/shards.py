"""Contigs dealt to shards, and results of shards merged."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.config import SearchConf
from strandloom.operators import search
from strandloom.operators.kept import kept
from strandloom.operators.ranks import ranked


def assignment(lengths: dict[int, int], shards: int, balanced: bool = True) -> dict[int, int]:
    """Shard of each contig: the longest first (in the given order if not balanced), each to the shard with the least load."""
    order = sorted(lengths, key=lambda c: (-lengths[c], c)) if balanced else list(lengths)
    loads = [(0, s) for s in range(shards)]
    out = {}
    for contig in order:
        load, s = heapq.heappop(loads)
        out[contig] = s
        heapq.heappush(loads, (load + lengths[contig], s))
    return out


def shares(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """The same dealing over counts of lengths: (length, first rank, last rank + 1, shard) of the contigs of a length.

    The n contigs of a length go where the n least loads are that a shard has before each of its next contigs; the n-th least is found by halving, so a length costs the same however many contigs have it."""
    loads, out = [0] * shards, []
    for length in sorted(counts, reverse=True):
        n = counts[length]
        if not length:  # no load: all to the least one
            out.append((0, 0, n, min(range(shards), key=lambda s: (loads[s], s))))
            continue
        low, high = min(loads), min(loads) + n * length  # the last contig's load before it is in low..high
        while low < high:
            mid = (low + high) // 2
            if sum(max(0, (mid - x) // length + 1) for x in loads) >= n:
                high = mid
            else:
                low = mid + 1
        below = [max(0, (low - 1 - x) // length + 1) for x in loads]
        left = n - sum(below)
        rank = 0
        for s in range(shards):
            own = below[s]
            if left and loads[s] <= low and (low - loads[s]) % length == 0:  # it has a place at just that load; the first shards take these
                own, left = own + 1, left - 1
            if own:
                out.append((length, rank, rank + own, s))
                loads[s] += own * length
                rank += own
    return out


def dealt(contigs: DataFrame, shards: int) -> DataFrame:
    """Adds shard: the longest contigs first, each to the shard with the least load. The plan is made from counts of lengths, of which B bases have at most (2 B) ** 0.5; contigs take their shard by their rank within their length."""
    sized = contigs.withColumn("_n", F.length("seq").cast("long"))
    told = sized.groupBy("_n").agg(F.count("*").alias("n")).toArrow()
    counts = dict(zip(told.column("_n").to_pylist(), told.column("n").to_pylist()))
    plan = contigs.sparkSession.createDataFrame(shares(counts, shards), "_n long, lo long, hi long, shard int")
    met = ranked(sized, "_n", ["contig_id"]).join(plan, "_n").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return met.select(*contigs.columns, "shard")


def write_shards(contigs: DataFrame, shards: int, path: str) -> None:
    """Contigs dealt to shards: their texts in a folder for each shard, the names and lengths of all as a table with a tab between, and the number of shards."""
    named = dealt(contigs, shards)
    named.write.partitionBy("shard").parquet(f"{path}/contigs")
    named.select("name", F.length("seq").cast("long").alias("length")).orderBy("name").coalesce(1).write.csv(f"{path}/header", sep="\t")
    contigs.sparkSession.createDataFrame([(str(shards),)], "value string").coalesce(1).write.text(f"{path}/count")


def read_shards(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame]:
    """The number of shards, the header (name, length; the plan fails at a name that occurs twice), and the contigs with their shard."""
    from strandloom.sources.sam import targets_of_table

    n = int(spark.read.text(f"{path}/count").first().value)
    return n, targets_of_table(spark, f"{path}/header"), spark.read.parquet(f"{path}/contigs")


def linked(rows: DataFrame, header: DataFrame, name: str = "rname") -> DataFrame:
    """Adds tid: the place in the header (name, tid) of the contig that a shard's row names; the plan fails at a name that the header lacks. Rows without a name have none."""
    met = rows.join(header.select(F.col("name").alias("_name"), "tid"), F.col(name) == F.col("_name"), "left").drop("_name")
    known = F.col("tid").isNotNull() | F.col(name).isNull() | (F.col(name) == "*")
    return met.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("no such contig in the header: "), F.col(name)))))


def partial(hits: DataFrame, shard: str = "shard") -> DataFrame:
    """The least number of differences of each read in each shard, and its count."""
    return hits.groupBy(shard, "read_id", "nm").agg(F.count("*").alias("n")).groupBy(shard, "read_id").agg(F.min(F.struct("nm", "n")).alias("best")).select(shard, "read_id", "best.nm", "best.n")


def final(partials: DataFrame) -> DataFrame:
    """Over shards: the least number of differences, and the sum of the counts of the shards that have it. Any order and grouping gives the same."""
    by_nm = partials.groupBy("read_id", "nm").agg(F.sum("n").alias("n"))
    return by_nm.groupBy("read_id").agg(F.min(F.struct("nm", "n")).alias("best")).select("read_id", "best.nm", "best.n")


def carried(reads: DataFrame, contigs: DataFrame, conf: SearchConf = SearchConf(), shards: list | None = None) -> tuple[DataFrame, list[int]]:
    """search() over contigs (contig_id, seq, shard) one shard after another: each looks for at most as many differences as the best hit so far has, and `delta` more. Also the number of candidates that each shard compared.

    The result is the same in any order of the shards; without a list they come in their own order. Reads, their budgets and a shard's hits are written between shards. A budget that falls means fewer and wider pieces, so fewer places meet one by chance."""
    order = [r.shard for r in contigs.select("shard").distinct().orderBy("shard").collect()] if shards is None else shards  # numbers of shards
    left = kept(search.budget(reads, conf).select("read_id", "seq", "max_errors"), "budgets")
    out, compared = None, []
    for s in order:
        watch = Observation(f"shard {s}")
        found = kept(search.within(left, contigs.where(F.col("shard") == s).select("contig_id", "seq"), conf, watch=watch), "hits")
        compared.append(watch.get["candidates"])
        out = found if out is None else out.unionByName(found)
        if s != order[-1]:
            best = found.groupBy("read_id").agg(F.min("nm").alias("nm"))
            left = kept(left.join(best, "read_id", "left").select("read_id", "seq", F.least("max_errors", "nm").cast("int").alias("max_errors")), "budgets")
    if out is None:
        return search.search(reads, contigs.select("contig_id", "seq"), conf), []
    return search.strata(out, conf.delta), compared
