"""Paired reads: nearest mates, joins of mates, and the records of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import PairConf
from strandloom.functions import sam


def zipped(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two files of mates by ordinal; the plan fails where their ids differ in more than the last character."""
    a = first.select("ordinal", *(F.col(c).alias(f"{c}1") for c in first.columns if c != "ordinal"))
    b = second.select("ordinal", *(F.col(c).alias(f"{c}2") for c in second.columns if c != "ordinal"))
    stem = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    same = stem(F.col("id1")) == stem(F.col("id2"))
    return a.join(b, "ordinal", "full").where(F.when(F.coalesce(same, F.lit(False)), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("mates differ at record"), F.col("ordinal").cast("string")))))


def nearest(unique: DataFrame, multiple: DataFrame, keys: list[str], same_strand: bool = False, keep: list[str] | None = None) -> DataFrame:
    """For each pair the hit of the other mate nearest to the unique one (ties: the smaller position), with `same_strand` on its strand only. `keep` names more columns of the other mate's hits."""
    met = unique.join(multiple.select(*keys, *(keep or []), F.col("pos").alias("mate_pos"), F.col("strand").alias("mate_strand")), keys)
    if same_strand:
        met = met.where(F.col("strand") == F.col("mate_strand"))
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col("pos") - F.col("mate_pos")), "mate_pos", "mate_strand")
    return met.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def mates(records: DataFrame) -> DataFrame:
    """Each record with its mate: the same name, the other place in the pair, at the position the record names for it."""
    other = records.select("qname", F.col("flag").alias("mate_flag"), F.col("pos").alias("mate_pos"), F.col("cigar").alias("mate_cigar"))
    met = records.join(other, "qname").where((F.col("pnext") == F.col("mate_pos")) & (sam.has(F.col("flag"), "first") != sam.has(F.col("mate_flag"), "first")))
    return met


def pair_fields(pairs: DataFrame, conf: PairConf = PairConf()) -> DataFrame:
    """Adds proper, tlen1, tlen2, flag1 and flag2 to pairs (contig, pos, end, strand, each with 1 and 2; pos 1-based, null when unmapped)."""
    c = F.col
    proper = sam.proper_pair(c("contig1"), c("pos1"), c("end1"), c("strand1"), c("contig2"), c("pos2"), c("end2"), c("strand2"), conf.insert_min, conf.insert_max)
    five = {i: sam.five_prime(c(f"pos{i}"), c(f"end{i}") - c(f"pos{i}") + 1, c(f"strand{i}")) for i in (1, 2)}
    out = pairs.withColumn("proper", proper)
    for i, j in ((1, 2), (2, 1)):
        bits = sam.flag(paired=F.lit(True), proper=c("proper"), unmapped=c(f"pos{i}").isNull(), mate_unmapped=c(f"pos{j}").isNull(), reverse=c(f"strand{i}") == "-", mate_reverse=c(f"strand{j}") == "-", first=F.lit(i == 1), second=F.lit(i == 2))
        out = out.withColumn(f"tlen{i}", F.coalesce(sam.tlen(c(f"contig{i}"), five[i], c(f"contig{j}"), five[j]), F.lit(0).cast("long"))).withColumn(f"flag{i}", bits)
    return out


def placed(pairs: DataFrame) -> DataFrame:
    """An unmapped mate takes contig and position of the mapped one."""
    return pairs.withColumns({f"{n}{i}": F.coalesce(f"{n}{i}", f"{n}{3 - i}") for n in ("contig", "pos") for i in (1, 2)})
