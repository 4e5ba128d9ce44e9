"""Coverage: what covers each position, per-base joins, counts by contig."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.functions import sam

#: Depths are summed up in bins of 2**BIN positions.
BIN = 14


def bases(records: DataFrame, mask: int = sam.PILEUP_MASK) -> DataFrame:
    """Records (contig_id, pos 0-based, cigar, seq, flag and more) to a row for each reference position they cover: ref, qpos, is_del, base, indel (length of the insertion, or less than 0 of the deletion, between this base and the next), is_head and is_tail (the first and the last base between clips and skipped stretches).

    Skipped stretches (N) give no rows; deletions give rows without a base. Nothing is shuffled or gathered, whatever the coverage."""
    kept = records.where(F.col("flag").bitwiseAND(mask) == 0).where(F.col("cigar") != "*")
    blocks = kept.withColumn("b", F.explode(C.blocks_around(F.col("cigar")))).where((F.col("b.op") != "N") & (F.col("b.len") > 0))
    each = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("b.len") - 1)))
    is_del = F.col("b.op") == "D"
    qpos = F.when(is_del, None).otherwise(F.col("b.query") + F.col("k"))
    at_end = F.col("k") == F.col("b.len") - 1
    place = [(F.col("pos").cast("long") + F.col("b.ref") + F.col("k")).alias("ref"), qpos.alias("qpos"), is_del.alias("is_del"), F.substr("seq", (qpos + 1).cast("int"), F.lit(1)).alias("base")]
    around = [F.when(at_end, F.col("b.indel")).otherwise(0).alias("indel"), (F.col("b.first") & (F.col("k") == 0)).alias("is_head"), (F.col("b.last") & at_end).alias("is_tail")]
    return each.select(*[c for c in records.columns if c not in ("seq", "cigar")], *place, *around)


def columns(records: DataFrame, mask: int = sam.PILEUP_MASK, partitions: int | None = None) -> DataFrame:
    """bases() in order of place and name. Ranges of (place, name) are dealt to tasks, so a place that very many records cover is dealt to several, and no task holds it at once."""
    own, order = bases(records, mask), ["contig_id", "ref", "qname"]
    dealt = own.repartitionByRange(partitions, *order) if partitions else own.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def runs(records: DataFrame, mask: int = sam.PILEUP_MASK) -> DataFrame:
    """Stretches of one depth: contig_id, begin, end (half open), depth (bases and deletions) and n_bases. A block of a record is two rows, +1 where it begins and -1 where it ends, and depths are running sums.

    Sums run within bins of 2**`BIN` positions, into which blocks are cut, so no task has a whole contig."""
    kept = records.where(F.col("flag").bitwiseAND(mask) == 0).where(F.col("cigar") != "*")
    blocks = kept.select("contig_id", F.explode(C.blocks(C.operations(F.col("cigar")), F.col("pos"))).alias("b")).where((F.col("b.op") != "N") & (F.col("b.len") > 0))
    spans = blocks.select("contig_id", F.col("b.ref").alias("begin"), (F.col("b.ref") + F.col("b.len")).alias("end"), (F.col("b.op") != "D").cast("long").alias("base"))
    bins = spans.withColumn("bin", F.explode(F.sequence(F.shiftright("begin", BIN), F.shiftright(F.col("end") - 1, BIN))))
    first = F.shiftleft(F.col("bin"), BIN)
    ends = F.array(F.struct(F.greatest("begin", first).alias("at"), F.lit(1).cast("long").alias("d"), F.col("base").alias("n")), F.struct(F.least("end", first + (1 << BIN)).alias("at"), F.lit(-1).cast("long").alias("d"), (-F.col("base")).alias("n")))
    steps = bins.select("contig_id", "bin", F.explode(ends).alias("e")).groupBy("contig_id", "bin", "e.at").agg(F.sum("e.d").alias("d"), F.sum("e.n").alias("n"))
    own = Window.partitionBy("contig_id", "bin").orderBy("at")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.select("contig_id", F.col("at").alias("begin"), F.lead("at").over(own).alias("end"), F.sum("d").over(upto).alias("depth"), F.sum("n").over(upto).alias("n_bases"))
    return summed.where("depth > 0")


def depth(records: DataFrame, mask: int = sam.PILEUP_MASK) -> DataFrame:
    """contig_id, ref and the number of records that have a base or a deletion there, and of those with a base."""
    return runs(records, mask).select("contig_id", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("ref"), "depth", "n_bases")


def pileup(records: DataFrame, mask: int = sam.PILEUP_MASK) -> DataFrame:
    """Each position with the records that cover it, in order of their names. For bounded coverage; columns() and depth() have no such bound."""
    own = bases(records, mask)
    return own.groupBy("contig_id", "ref").agg(F.array_sort(F.collect_list(F.struct("qname", "qpos", "is_del", "base"))).alias("column"))


def pileup_of_files(files: dict[str, DataFrame], mask: int = sam.PILEUP_MASK) -> DataFrame:
    """Depth by position with a column for each file."""
    out = None
    for name, records in files.items():
        own = bases(records, mask).withColumn("file", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("contig_id", "ref").pivot("file", sorted(files)).count().na.fill(0)


def idxstats(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (contig_id, length) with numbers of mapped and unmapped records, and a row of contig_id null for records without a place."""
    unmapped = sam.has(F.col("flag"), "unmapped")
    counts = records.groupBy("contig_id").agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    placed = targets.select("contig_id", "length").join(counts, "contig_id", "left").select("contig_id", "length", zero("mapped"), zero("unmapped"))
    return placed.unionByName(counts.where("contig_id is null").select("contig_id", F.lit(0).cast("long").alias("length"), "mapped", "unmapped"))
