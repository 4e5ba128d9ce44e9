"""From two files of mates to the records of their pairs: trimming, admission, contamination, search, choice of mates, and the fields of SAM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import PairConf, SearchConf, TrimConf
from strandloom.functions import cigar as G
from strandloom.functions import sam
from strandloom.functions import seq as S
from strandloom.operators import search, trim

#: Which of a pair's records are written.
METHODS = {"none": (), "first": (1,), "second": (2,), "both": (1, 2)}


def mates_of(pairs: DataFrame) -> DataFrame:
    """Pairs (ordinal, id1, seq1, qual1, id2, seq2, qual2, as of pairs.zipped) to a row for each mate: pair_id, mate (1, 2), read_id (2 * pair + mate - 1), qname, seq, qual."""
    side = lambda i: F.struct(F.lit(i).alias("mate"), F.col(f"seq{i}").alias("seq"), F.col(f"qual{i}").alias("qual"))
    both = pairs.select(F.col("ordinal").cast("long").alias("pair_id"), sam.common_name(F.col("id1"), F.col("id2")).alias("qname"), F.explode(F.array(side(1), side(2))).alias("m"))
    return both.select("pair_id", "qname", "m.*").withColumn("read_id", F.col("pair_id") * 2 + F.col("mate") - 1)


def admitted(mates: DataFrame, conf: SearchConf) -> DataFrame:
    """Adds good (the bases to search), low_quality and searchable to trimmed mates. A mate is searched if it wasn't discarded itself and its good part has no more N than it may have errors, whatever became of the other."""
    good = S.good_part(F.col("seq"), F.col("good_start"), F.col("good_stop"), F.col("discarded"))
    out = mates.withColumn("good", good)
    errors = S.error_budget(F.length("good"), conf.errors_rate) if conf.auto_errors else F.lit(conf.errors)
    searchable = ~F.col("discarded") & (F.length("good") > 0) & (S.n_count(F.upper("good")) <= errors)
    return out.withColumn("searchable", searchable).withColumn("low_quality", ~F.col("searchable"))


def primary(hits: DataFrame) -> DataFrame:
    """Numbered hits of mates (pair_id, mate, contig_id, pos, strand, nh, hi): adds is_primary. Where one mate has one hit and the other several on its contig, the nearest of these is primary (of equals the smaller position); else the first."""
    one = hits.where("nh = 1").select("pair_id", (3 - F.col("mate")).alias("mate"), F.col("contig_id").alias("_contig"), F.col("pos").alias("_pos"))
    met = hits.join(one, ["pair_id", "mate"], "left")
    apart = F.when(F.col("_contig") == F.col("contig_id"), F.abs(F.col("pos") - F.col("_pos")))
    order = Window.partitionBy("pair_id", "mate").orderBy(apart.asc_nulls_last(), F.when(apart.isNotNull(), F.col("pos")).asc_nulls_last(), "hi")
    return met.withColumn("is_primary", F.row_number().over(order) == 1).drop("_contig", "_pos")


def records(mates: DataFrame, hits: DataFrame, names: DataFrame, conf: PairConf = PairConf(), method: str = "both", first: int | None = 1, group: str | None = None, program: str | None = None) -> DataFrame:
    """The records of pairs, in the columns of sam.COLUMNS and tags.

    `mates` (of admitted, with contaminant, the name of what it is contaminated by or null), `hits` (read_id, contig_id, pos, strand, nm; CIGARs of their own are taken from cigar if it is there), `names` (contig_id, name). A mate has a record for each of its `first` best hits, the first of
    which is primary and the others secondary, or one without a place. A mate without a place takes that of the other; both of a pair without any have none.
    Each record tells of the other mate's primary hit."""
    if method not in METHODS:
        raise ValueError(f"the method is one of {', '.join(METHODS)}")
    c = F.col
    numbered = search.numbered(hits.select("read_id", "contig_id", "pos", "strand", "nm", *(["cigar"] if "cigar" in hits.columns else [])))
    own = numbered.drop("is_primary").withColumns({"pair_id": F.floor(c("read_id") / 2), "mate": (c("read_id") % 2 + 1).cast("int")})
    ready = primary(own)
    # The primary hit is written first, then the others in order.
    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("is_primary"), "hi"))
    kept = ready.withColumn("rank", rank)
    kept = kept if first is None else kept.where(c("rank") <= first)
    named = kept.join(names.select("contig_id", c("name").alias("rname")), "contig_id").drop("pair_id", "mate", "hi")
    rows = mates.join(named, "read_id", "left")
    left, n = F.coalesce(c("good_start"), F.lit(1)) - 1, F.length("good")
    right = F.length("seq") - left - n
    clip = [F.when(c("strand") == "+", left).otherwise(right), F.when(c("strand") == "+", right).otherwise(left)]
    built = G.build(n, *clip)
    if "cigar" in hits.columns:
        soft = lambda x: F.when(x > 0, F.concat(x.cast("string"), F.lit("S"))).otherwise("")
        built = F.when(c("cigar").isNotNull(), F.concat(soft(clip[0]), c("cigar"), soft(clip[1]))).otherwise(built)
    rows = rows.withColumn("cigar", built)
    rows = trim.settled(trim.settled(rows).withColumn("end", c("pos") + G.reference_span(G.operations(c("cigar")))))  # 0-based, exclusive
    other = rows.where(F.coalesce("is_primary", F.lit(False))).select("pair_id", (3 - c("mate")).alias("mate"), c("rname").alias("o_rname"), c("pos").alias("o_pos"), c("end").alias("o_end"), c("strand").alias("o_strand"))
    met = rows.join(other, ["pair_id", "mate"], "left")
    placed, other_placed = c("rname").isNotNull(), c("o_rname").isNotNull()
    proper = sam.proper_pair(c("rname"), c("pos") + 1, c("end"), c("strand"), c("o_rname"), c("o_pos") + 1, c("o_end"), c("o_strand"), conf.insert_min, conf.insert_max)
    bits = sam.flag(
        paired=F.lit(True), proper=proper, unmapped=~placed, mate_unmapped=~other_placed, reverse=c("strand") == "-", mate_reverse=c("o_strand") == "-", first=c("mate") == 1, second=c("mate") == 2,
        secondary=placed & (c("rank") > 1), qc_fail=~placed & c("low_quality"),
    )
    five = lambda pos, end, strand: sam.five_prime(pos + 1, end - pos, strand)
    tlen = F.coalesce(sam.tlen(c("rname"), five(c("pos"), c("end"), c("strand")), c("o_rname"), five(c("o_pos"), c("o_end"), c("o_strand"))), F.lit(0).cast("long"))
    minus = c("strand") == "-"
    mate_name, mate_pos = F.coalesce("o_rname", "rname"), F.coalesce("o_pos", "pos")
    place, at = F.coalesce("rname", "o_rname"), F.coalesce("pos", "o_pos")
    tags = {"RG": F.lit(group), "PG": F.lit(program), "NM": c("nm").cast("string"), "NH": F.coalesce(c("nh"), F.lit(0)).cast("string"), "IH": F.when(placed, F.least(c("nh"), F.lit(first) if first is not None else c("nh"))).otherwise(0).cast("string"), "HI": c("rank").cast("string"), "XC": c("contaminant")}
    typed = [F.struct(F.lit("Z" if k in ("RG", "PG", "XC") else "i").alias("code"), v.cast("string").alias("value")) for k, v in tags.items()]
    map_ = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*typed)), lambda k, v: v["value"].isNotNull())
    fields: dict[str, Column] = {
        "qname": c("qname"), "flag": bits, "rname": F.coalesce(place, F.lit("*")), "pos": F.coalesce(at + 1, F.lit(0)).cast("long"), "mapq": F.when(placed, sam.mapq(c("nh"))).otherwise(0), "cigar": F.when(placed, c("cigar")).otherwise("*"),
        "rnext": F.when(mate_name.isNull(), "*").when(mate_name == place, "=").otherwise(mate_name), "pnext": F.coalesce(mate_pos + 1, F.lit(0)).cast("long"), "tlen": tlen,
        "seq": F.when(minus, S.revcomp(c("seq"))).otherwise(c("seq")), "qual": F.when(minus, F.reverse("qual")).otherwise(c("qual")), "tags": map_,
    }
    return met.where(c("mate").isin(*METHODS[method], -1)).select(*(v.alias(k) for k, v in fields.items()))


def align(pairs: DataFrame, contigs: DataFrame, conf: SearchConf = SearchConf(), trimming: TrimConf = TrimConf(), pair_conf: PairConf = PairConf(), contaminants: DataFrame | None = None, method: str = "both", group: str | None = None, program: str | None = None) -> DataFrame:
    """Zipped mates to records: contigs (contig_id, name, seq), contaminants the same. Contaminated mates aren't searched, and named so in XC. With conf.indels mates without a hit are aligned with gaps."""
    from strandloom.operators import dp

    mates = trim.settled(admitted(trim.settled(trim.trim(trim.settled(mates_of(pairs)), trimming)), conf))
    reads = mates.where("searchable").select("read_id", F.upper("good").alias("seq"))
    if contaminants is not None:
        found = search.contaminated(reads, contaminants, conf).join(contaminants.select(F.col("contig_id").alias("contaminant"), F.col("name").alias("_name")), "contaminant").select("read_id", F.col("_name").alias("contaminant"))
        reads = reads.join(found, "read_id", "left_anti")
        mates = mates.join(found, "read_id", "left")
    else:
        mates = mates.withColumn("contaminant", F.lit(None).cast("string"))
    hits = search.search(reads, contigs, conf).select("read_id", "contig_id", "pos", "strand", "nm")
    if conf.indels:
        gaps = dp.indel_search(reads, contigs, conf).select("read_id", "contig_id", "pos", "strand", (F.col("mismatches") + F.col("indels")).alias("nm"), "cigar")
        hits = hits.withColumn("cigar", F.lit(None).cast("string")).unionByName(gaps)
    return records(mates, hits, contigs, pair_conf, method, conf.print_first, group, program)
