"""Queries over pairs, records, intervals, shards and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.config import PairConf, SearchConf
from strandloom.functions import cigar as G
from strandloom.functions import sam
from strandloom.functions import seq as S
from strandloom.operators import contigs as C
from strandloom.operators import methyl, pairs, routes, search, shards
from strandloom.plans import views as V
from strandloom.plans.registry import query, table

#: Mates as hits: contig, position, end and strand made from lengths and ids.
PAIRS_SQL = f"WITH {V.MATES_SQL}, p AS (SELECT conv_id, k, conv_id % 3 AS contig1, (conv_id + CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END) % 3 AS contig2, 100 + length(seq1) AS pos1, 100 + length(seq1) + 59 AS end1, 150 + length(seq2) AS pos2, 150 + length(seq2) + 59 AS end2, CASE WHEN k % 4 = 3 THEN '-' ELSE '+' END AS strand1, CASE WHEN k % 7 = 6 THEN '+' ELSE '-' END AS strand2 FROM mates)"


def _pairs(spark, sf):
    n1, n2, k, c = F.length("seq1").cast("long"), F.length("seq2").cast("long"), F.col("k"), F.col("conv_id")
    return V.mates(spark, sf).select("conv_id", "k", (c % 3).alias("contig1"), ((c + F.when(k % 5 == 4, 1).otherwise(0)) % 3).alias("contig2"), (n1 + 100).alias("pos1"), (n1 + 159).alias("end1"), (n2 + 150).alias("pos2"), (n2 + 209).alias("end2"), F.when(k % 4 == 3, "-").otherwise("+").alias("strand1"), F.when(k % 7 == 6, "+").otherwise("-").alias("strand2"))


PROPER = "coalesce(contig1 = contig2 AND CASE WHEN strand1 = '+' AND strand2 = '-' THEN pos1 <= end2 WHEN strand1 = '-' AND strand2 = '+' THEN pos2 <= end1 ELSE false END AND greatest(end1, end2) - least(pos1, pos2) + 1 BETWEEN 0 AND 400, false)"
FIVE = "CASE WHEN strand{0} = '+' THEN pos{0} ELSE end{0} END"


@query("proper_pair", PAIRS_SQL + f" SELECT conv_id, k, {PROPER} AS proper FROM p")
def proper_pair(spark, sf):
    return pairs.pair_fields(_pairs(spark, sf), PairConf(0, 400)).select("conv_id", "k", "proper")


@query("tlen", PAIRS_SQL + f" SELECT conv_id, k, CASE WHEN contig1 = contig2 THEN {FIVE.format(2)} - {FIVE.format(1)} ELSE 0 END AS tlen1, CASE WHEN contig1 = contig2 THEN {FIVE.format(1)} - {FIVE.format(2)} ELSE 0 END AS tlen2 FROM p")
def tlen(spark, sf):
    return pairs.pair_fields(_pairs(spark, sf)).select("conv_id", "k", "tlen1", "tlen2")


@query("sam_flags", PAIRS_SQL + f" SELECT conv_id, k, 1 + CASE WHEN {PROPER} THEN 2 ELSE 0 END + CASE strand1 WHEN '-' THEN 16 ELSE 0 END + CASE strand2 WHEN '-' THEN 32 ELSE 0 END + 64 AS flag1, 1 + CASE WHEN {PROPER} THEN 2 ELSE 0 END + CASE strand2 WHEN '-' THEN 16 ELSE 0 END + CASE strand1 WHEN '-' THEN 32 ELSE 0 END + 128 AS flag2 FROM p")
def sam_flags(spark, sf):
    return pairs.pair_fields(_pairs(spark, sf), PairConf(0, 400)).select("conv_id", "k", "flag1", "flag2")


@query("flag_letters", PAIRS_SQL + " SELECT conv_id, k, 'p' || CASE strand1 WHEN '-' THEN 'r' ELSE '' END || CASE strand2 WHEN '-' THEN 'R' ELSE '' END || '1' AS letters, CASE WHEN k % 2 = 0 THEN 60 ELSE 0 END AS mapq, CASE WHEN k % 3 = 0 THEN 'Q' WHEN k % 3 = 1 THEN 'A' ELSE 'E' END AS status FROM p")
def flag_letters(spark, sf):
    k = F.col("k")
    flag = sam.flag(paired=F.lit(True), reverse=F.col("strand1") == "-", mate_reverse=F.col("strand2") == "-", first=F.lit(True))
    return _pairs(spark, sf).select("conv_id", "k", sam.flag_letters(flag).alias("letters"), sam.mapq(k % 2 + 1).alias("mapq"), sam.status(k % 3, k % 3 == 0, F.lit(False)).alias("status"))


@query("nearest_mate", f"WITH {V.MATES_SQL}, u AS (SELECT conv_id, k, length(seq1) AS pos FROM mates), m AS (SELECT conv_id, k, length(seq2) + 40 * j AS mp FROM mates, (SELECT unnest(range(-3, 4)) AS j)) SELECT conv_id, k, pos, mp AS mate_pos FROM (SELECT u.*, mp, row_number() OVER (PARTITION BY u.conv_id, u.k ORDER BY abs(pos - mp), mp) AS rn FROM u JOIN m ON u.conv_id = m.conv_id AND u.k = m.k) WHERE rn = 1")
def nearest_mate(spark, sf):
    rows = V.mates(spark, sf)
    unique = rows.select("conv_id", "k", F.length("seq1").cast("long").alias("pos"), F.lit("+").alias("strand"))
    many = rows.select("conv_id", "k", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("j"), F.length("seq2").alias("n")).select("conv_id", "k", (F.col("n") + 40 * F.col("j")).cast("long").alias("pos"), F.lit("-").alias("strand"))
    return pairs.nearest(unique, many, ["conv_id", "k"]).select("conv_id", "k", "pos", "mate_pos")


@query("mate_self_join", PAIRS_SQL + " SELECT conv_id || '.' || k AS qname, pos1 AS pos, pos2 AS mate_pos, 65 AS flag FROM p UNION ALL SELECT conv_id || '.' || k, pos2, pos1, 129 FROM p")
def mate_self_join(spark, sf):
    p = _pairs(spark, sf).withColumn("qname", F.concat_ws(".", "conv_id", "k"))
    side = lambda i, flag: p.select("qname", F.lit(flag).alias("flag"), F.col(f"pos{i}").alias("pos"), F.col(f"pos{3 - i}").alias("pnext"), F.lit("60M").alias("cigar"))
    return pairs.mates(side(1, 65).unionByName(side(2, 129))).select("qname", "pos", "mate_pos", "flag")


ROUTES_SQL = f"WITH {V.MATES_SQL}, g AS (SELECT conv_id, k, length(seq1) AS length1, length(seq2) AS length2, length(seq1) >= 150 AS good1, length(seq2) >= 150 AS good2, conv_id % 5 = 0 AS bad1, (conv_id + k) % 5 = 1 AS bad2 FROM mates), r AS (SELECT *, CASE WHEN good1 AND good2 THEN CASE WHEN NOT (bad1 OR bad2) THEN 'paired' END WHEN good1 THEN CASE WHEN NOT bad1 THEN 'unpaired' END WHEN good2 THEN CASE WHEN NOT bad2 THEN 'unpaired' END END AS route FROM g)"


def _judged(spark, sf):
    n1, n2, c = F.length("seq1"), F.length("seq2"), F.col("conv_id")
    return V.mates(spark, sf).select("conv_id", "k", n1.alias("length1"), n2.alias("length2"), (n1 >= 150).alias("good1"), (n2 >= 150).alias("good2"), (c % 5 == 0).alias("bad1"), ((c + F.col("k")) % 5 == 1).alias("bad2"))


@query("filter_routes", ROUTES_SQL + " SELECT conv_id, k, route FROM r")
def filter_routes(spark, sf):
    return routes.routed(_judged(spark, sf)).select("conv_id", "k", "route")


@query("filter_counters", ROUTES_SQL + ", c AS (SELECT *, CAST(good1 AS INTEGER) + CAST(good2 AS INTEGER) AS g, CASE route WHEN 'paired' THEN 2 WHEN 'unpaired' THEN 1 ELSE 0 END AS p FROM r) SELECT count(*) * 2 AS total, CAST(sum(p) AS BIGINT) AS passed, CAST(sum(2 - g) AS BIGINT) AS low_quality, CAST(sum(g - p) AS BIGINT) AS contaminated, CAST(sum(CASE route WHEN 'paired' THEN length1 + length2 WHEN 'unpaired' THEN CASE WHEN good1 THEN length1 ELSE length2 END ELSE 0 END) AS BIGINT) AS total_length FROM c")
def filter_counters(spark, sf):
    return routes.counters(_judged(spark, sf))


@query("point_in_contig", f"WITH {V.CONTIGS_SQL}, o AS (SELECT contig_id, length(seq) AS n, coalesce(sum(length(seq) + 1) OVER (ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM contigs) SELECT e.event_id, o.contig_id, CAST(e.at - o.s AS BIGINT) AS pos FROM (SELECT event_id, event_id * 997 AS at FROM events) e JOIN o ON e.at >= o.s AND e.at < o.s + o.n")
def point_in_contig(spark, sf):
    points = table(spark, sf, "events").select("event_id", (F.col("event_id") * 997).alias("at"))
    return search.locate(points, C.with_offsets(V.contigs(spark, sf))).select("event_id", "contig_id", "pos")


@query("interval_overlap", "WITH o AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate) // 86400 AS b, epoch(o_orderdate) // 86400 + 30 AS e FROM orders) SELECT x.o_orderkey AS a, y.o_orderkey AS b, least(x.e, y.e) - greatest(x.b, y.b) AS days FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.b < y.e AND x.e > y.b")
def interval_overlap(spark, sf):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", day.alias("begin")).withColumn("end", F.col("begin") + 30)
    other = o.toDF("other_key", "o_custkey", "other_begin", "other_end")
    met = search.overlaps(o, other, ["o_custkey"], 64).where(F.col("o_orderkey") < F.col("other_key"))
    return met.select(F.col("o_orderkey").alias("a"), F.col("other_key").alias("b"), (F.least("end", "other_end") - F.greatest("begin", "other_begin")).alias("days"))


CIGARS_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS s, 1 + l_partkey % 50 AS m, 1 + l_suppkey % 3 AS i, 1 + l_partkey % 4 AS d, l_orderkey % 40 AS n FROM lineitem"
CIGAR_TEXT = "CASE WHEN s > 0 THEN s || 'S' ELSE '' END || m || 'M' || i || 'I' || m || 'M' || d || 'D' || m || 'M' || CASE WHEN n > 0 THEN n || 'N' || m || 'M' ELSE '' END || '2S1H'"


def _cigars(spark, sf):
    c = F.col
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_suppkey") % 7).alias("s"), (c("l_partkey") % 50 + 1).alias("m"), (c("l_suppkey") % 3 + 1).alias("i"), (c("l_partkey") % 4 + 1).alias("d"), (c("l_orderkey") % 40).alias("n"))
    part = lambda x, op: F.concat(c(x).cast("string"), F.lit(op))
    text = F.concat(F.when(c("s") > 0, part("s", "S")).otherwise(""), part("m", "M"), part("i", "I"), part("m", "M"), part("d", "D"), part("m", "M"), F.when(c("n") > 0, F.concat(part("n", "N"), part("m", "M"))).otherwise(""), F.lit("2S1H"))
    return rows.select("l_orderkey", "l_linenumber", text.alias("cigar"))


@query("cigar_span", f"SELECT l_orderkey, l_linenumber, {CIGAR_TEXT} AS cigar, CAST(3 * m + d + CASE WHEN n > 0 THEN n + m ELSE 0 END AS INTEGER) AS span, CAST(s + 3 * m + i + CASE WHEN n > 0 THEN m ELSE 0 END + 2 AS INTEGER) AS qlen FROM ({CIGARS_SQL})")
def cigar_span(spark, sf):
    ops = G.operations(F.col("cigar"))
    return _cigars(spark, sf).select("l_orderkey", "l_linenumber", G.text(ops).alias("cigar"), G.reference_span(ops).alias("span"), G.query_length(ops).alias("qlen"))


@query("cigar_clips", f"SELECT l_orderkey, l_linenumber, CAST(s AS INTEGER) AS left_clip, 2 AS right_clip FROM ({CIGARS_SQL})")
def cigar_clips(spark, sf):
    ops = G.operations(F.col("cigar"))
    return _cigars(spark, sf).select("l_orderkey", "l_linenumber", G.left_clip(ops).alias("left_clip"), G.right_clip(ops).alias("right_clip"))


@query("ucsc_bins", "SELECT l_orderkey, l_linenumber, CASE WHEN b >> 14 = e >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = e >> 17 THEN 585 + (b >> 17) WHEN b >> 20 = e >> 20 THEN 73 + (b >> 20) WHEN b >> 23 = e >> 23 THEN 9 + (b >> 23) WHEN b >> 26 = e >> 26 THEN 1 + (b >> 26) ELSE 0 END AS bin FROM (SELECT l_orderkey, l_linenumber, l_partkey * 997 AS b, l_partkey * 997 + l_suppkey * 1000 AS e FROM lineitem)")
def ucsc_bins(spark, sf):
    begin = F.col("l_partkey") * 997
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", G.ucsc_bin(begin, begin + F.col("l_suppkey") * 1000 + 1).cast("long").alias("bin"))


@query("unpack_tags", "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS nm, l_returnflag AS rg, l_quantity AS qty FROM lineitem")
def unpack_tags(spark, sf):
    text = sam.tags(NM_int=F.col("l_partkey"), RG_string=F.col("l_returnflag"), XQ_string=F.col("l_quantity"))
    tags = sam.tag_map(text)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tags["NM"].alias("nm"), tags["RG"].alias("rg"), tags["XQ"].cast("double").alias("qty"))


CALLS_SQL = "SELECT lang, quality AS truth, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS call FROM labels JOIN documents USING (doc_id)"


@query("confusion_grouping_sets", f"SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM (SELECT lang, count(*) FILTER (truth = 1 AND call = 1) AS tp, count(*) FILTER (truth = 0 AND call = 0) AS tn, count(*) FILTER (truth = 0 AND call = 1) AS fp, count(*) FILTER (truth = 1 AND call = 0) AS fn FROM ({CALLS_SQL}) GROUP BY GROUPING SETS ((), (lang)))")
def confusion_grouping_sets(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("lang", F.col("quality").alias("truth"), (F.col("n_chars") > 1000).cast("int").alias("call"))
    return methyl.confusion(rows, ["lang"])


@query("error_histogram_51", "SELECT round(k / 50, 6) AS bin, count(x) AS n FROM (SELECT unnest(range(51)) AS k) LEFT JOIN (SELECT CAST(floor(l_discount * 10 * 50) AS INTEGER) AS x FROM lineitem) ON k = x GROUP BY k")
def error_histogram_51(spark, sf):
    return methyl.error_histogram(table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("e")), "e")


@query("shard_partial_final", "WITH s AS (SELECT l_partkey AS read_id, CAST(l_quantity AS INTEGER) AS nm FROM lineitem) SELECT read_id, min(nm) AS nm, count(*) FILTER (nm = least) AS n FROM (SELECT *, min(nm) OVER (PARTITION BY read_id) AS least FROM s) GROUP BY read_id")
def shard_partial_final(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("read_id"), (F.col("l_suppkey") % 4).alias("shard"), F.col("l_quantity").cast("int").alias("nm"))
    return shards.final(shards.partial(rows))


LPT = (
    f"WITH RECURSIVE {V.CONTIGS_SQL}, o AS (SELECT row_number() OVER (ORDER BY length(seq) DESC, contig_id) AS i, length(seq) AS n FROM contigs), "
    "r AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(range(8), lambda x: CAST(0 AS BIGINT)) AS loads, list_transform(range(8), lambda x: CAST(0 AS BIGINT)) AS counts "
    "UNION ALL SELECT o.i, list_transform(range(1, 9), lambda s: loads[s] + CASE WHEN s = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END), list_transform(range(1, 9), lambda s: counts[s] + CASE WHEN s = list_position(loads, list_min(loads)) THEN 1 ELSE 0 END) FROM r JOIN o ON o.i = r.i + 1) "
    "SELECT CAST(s - 1 AS INTEGER) AS shard, counts[s] AS contigs, loads[s] AS bases FROM (SELECT *, unnest(range(1, 9)) AS s FROM r WHERE i = (SELECT count(*) FROM o)) WHERE counts[s] > 0"
)


@query("lpt_assignment", LPT)
def lpt_assignment(spark, sf):
    return shards.dealt(V.contigs(spark, sf), 8).groupBy("shard").agg(F.count("*").alias("contigs"), F.sum(F.length("seq")).alias("bases"))


@query("methyl_score_rank", "WITH c AS (SELECT l_orderkey AS read_id, l_linenumber AS contig_id, l_partkey AS pos, l_discount * 100 AS distance, l_quantity AS cov_avg, 1 + l_suppkey % 12 AS n_covered FROM lineitem), r AS (SELECT *, min(n_covered) OVER (PARTITION BY read_id) AS least, row_number() OVER (PARTITION BY read_id ORDER BY floor(distance), cov_avg, contig_id DESC, pos DESC) AS rn FROM c) SELECT read_id, contig_id, pos FROM r WHERE least >= 3 AND rn = 1 AND distance / n_covered <= 1.0")
def methyl_score_rank(spark, sf):
    c = F.col
    rows = table(spark, sf, "lineitem").select(c("l_orderkey").alias("read_id"), c("l_linenumber").alias("contig_id"), c("l_partkey").alias("pos"), F.lit("+").alias("strand"), (c("l_discount") * 100).alias("distance"), c("l_quantity").alias("cov_avg"), (c("l_suppkey") % 12 + 1).alias("n_covered"))
    return methyl.decided(rows, 3, 1.0).select("read_id", "contig_id", "pos")


@query("region_parse", "SELECT c_custkey, c_name AS name, c_custkey AS begin, c_custkey + 500 AS \"end\" FROM customer")
def region_parse(spark, sf):
    text = F.concat(F.col("c_name"), F.lit(":"), F.format_number(F.col("c_custkey") + 1, 0), F.lit("-"), F.format_number(F.col("c_custkey") + 500, 0))
    return table(spark, sf, "customer").select("c_custkey", sam.region(text).alias("r")).select("c_custkey", "r.*")


@query("linked_header", "SELECT s_suppkey, CAST(n_nationkey AS INTEGER) AS tid FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def linked_header(spark, sf):
    """Rows that name a contig, with its place in the header."""
    nation = table(spark, sf, "nation")
    rows = table(spark, sf, "supplier").join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("rname"))
    return shards.linked(rows, nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("tid"))).select("s_suppkey", "tid")


@query("colour_space", f"SELECT item_id, left(s, 1) || array_to_string(list_transform(range(1, length(s)), lambda i: CASE WHEN substr(s, i, 1) = substr(s, i + 1, 1) THEN '0' WHEN substr(s, i, 2) IN ('AC', 'CA', 'GT', 'TG') THEN '1' WHEN substr(s, i, 2) IN ('AG', 'GA', 'CT', 'TC') THEN '2' ELSE '3' END), '') AS colours, s AS bases, 'T01$$2' AS missing FROM (SELECT item_id, {V.dna_sql('text')} AS s FROM benchmark) WHERE length(s) > 1")
def colour_space(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", S.dna(F.col("text")).alias("s")).where(F.length("s") > 1).withColumn("colours", S.colours(F.col("s")))
    return rows.select("item_id", "colours", S.bases_of_colours(F.col("colours")).alias("bases"), S.missing_colours(F.lit("T01..2")).alias("missing"))


REVERSED_CIGAR = "'1H2S' || CASE WHEN n > 0 THEN m || 'M' || n || 'N' ELSE '' END || m || 'M' || d || 'D' || m || 'M' || i || 'I' || m || 'M' || CASE WHEN s > 0 THEN s || 'S' ELSE '' END"


@query("reversed_records", f"SELECT l_orderkey, l_linenumber, {REVERSED_CIGAR} AS cigar, 'TTNAC' AS seq, '!5III' AS qual, 16 AS flag FROM ({CIGARS_SQL})")
def reversed_records(spark, sf):
    from strandloom.sources.sam import reversed_records as turned

    return turned(_cigars(spark, sf).withColumns({"seq": F.lit("GTNAA"), "qual": F.lit("III5!"), "flag": F.lit(0)}))


DECISIONS_SQL = "SELECT o_orderkey, CASE WHEN a = 'none' AND b = 'none' THEN 'drop' WHEN a = 'unique' AND b = 'unique' THEN CASE WHEN same THEN 'both' ELSE 'drop' END WHEN a = 'unique' AND b = 'none' THEN 'first' WHEN a = 'none' AND b = 'unique' THEN 'second' WHEN a = 'unique' THEN 'second_near_first' WHEN b = 'unique' THEN 'first_near_second' ELSE 'wait' END AS decision FROM (SELECT o_orderkey, ['none', 'unique', 'multiple'][o_orderkey % 3 + 1] AS a, ['none', 'unique', 'multiple'][o_custkey % 3 + 1] AS b, o_orderstatus = 'O' AS same FROM orders)"


@query("pair_decisions", DECISIONS_SQL)
def pair_decisions(spark, sf):
    kind = lambda c: F.element_at(F.array(F.lit("none"), F.lit("unique"), F.lit("multiple")), (F.col(c) % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", methyl.pair_decision(kind("o_orderkey"), kind("o_custkey"), F.col("o_orderstatus") == "O").alias("decision"))


@query("validated_calls", "WITH t AS (SELECT CASE WHEN o_orderstatus = 'O' THEN '+' ELSE '-' END AS strand, o_orderkey % 2 AS truth, floor(o_totalprice) % 101 / 100 AS level, o_custkey % 17 AS coverage FROM orders) SELECT strand, CAST(count(*) FILTER (truth = 1 AND level > 0.5) AS BIGINT) AS tp, CAST(count(*) FILTER (truth = 0 AND level <= 0.5) AS BIGINT) AS tn, CAST(count(*) FILTER (truth = 0 AND level > 0.5) AS BIGINT) AS fp, CAST(count(*) FILTER (truth = 1 AND level <= 0.5) AS BIGINT) AS fn FROM t WHERE coverage >= 10 GROUP BY GROUPING SETS ((), (strand))")
def validated_calls(spark, sf):
    """Calls joined with the truth by position, and the confusion of the two."""
    c = F.col
    rows = table(spark, sf, "orders").select(c("o_custkey").alias("contig_id"), c("o_orderkey").alias("ref"), F.when(c("o_orderstatus") == "O", "+").otherwise("-").alias("strand"), (c("o_orderkey") % 2 == 1).alias("methylated"), (F.floor("o_totalprice") % 101 / 100).alias("level"), (c("o_custkey") % 17).alias("coverage"))
    met = methyl.validated(rows.drop("methylated"), rows.select("contig_id", "ref", "strand", "methylated"), 10)
    return methyl.confusion(met, ["strand"]).drop("sensitivity", "specificity")


@query("run_statistics", "WITH r AS (SELECT l_orderkey, ['CG', 'CHG', 'CHH'][l_suppkey % 3 + 1] AS context, l_quantity AS n, l_discount * 10 AS level FROM lineitem), k AS (SELECT ['none', 'unique', 'multiple'][o_orderkey % 3 + 1] AS kind FROM orders) SELECT a.*, b.* FROM (SELECT count(*) AS reads, round(count(*) FILTER (kind = 'unique') / count(*), 6) AS \"unique\", round(count(*) FILTER (kind = 'multiple') / count(*), 6) AS multiple, round(count(*) FILTER (kind = 'none') / count(*), 6) AS \"none\" FROM k) a, (SELECT count(*) AS covered, count(*) FILTER (level > 0.5) AS methylated, round(sum(n) / count(*), 6) AS mean_coverage, " + ", ".join(f"round(count(*) FILTER (context = '{k}') / count(*), 6) AS covered_{k}, round(count(*) FILTER (context = '{k}' AND level > 0.5) / nullif(count(*) FILTER (context = '{k}'), 0), 6) AS methylated_{k}" for k in ("CG", "CHG", "CHH")) + " FROM r) b")
def run_statistics(spark, sf):
    context = F.element_at(F.array(F.lit("CG"), F.lit("CHG"), F.lit("CHH")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    report = table(spark, sf, "lineitem").select(F.concat(context, F.lit(":"), F.col("l_quantity").cast("long")).alias("ctx_cov"), (F.col("l_discount") * 10).alias("level"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"))
    kind = F.element_at(F.array(F.lit("none"), F.lit("unique"), F.lit("multiple")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return methyl.statistics(methyl.summary(report), table(spark, sf, "orders").select(kind.alias("kind")))


#: Mates with made-up hits: the first one unless k % 3 is 2, the second unless k % 4 is 3, and once more for every fifth.
PAIRED_SQL = f"""WITH {V.MATES_SQL}, m AS (SELECT conv_id * 4096 + k AS pair, k, conv_id, length(seq1) AS n1, length(seq2) AS n2, seq1, seq2 FROM mates WHERE length(seq1) > 0 AND length(seq2) > 0),
h AS (SELECT pair, 1 AS mate, 100 + n1 AS pos, '+' AS strand, 1 AS nm, conv_id % 3 AS contig, n1 AS n, 1 AS hit FROM m WHERE k % 3 <> 2 UNION ALL SELECT pair, 2, 150 + n2, '-', 2, conv_id % 3, n2, 1 FROM m WHERE k % 4 <> 3 UNION ALL SELECT pair, 2, 5000 + n2, '+', 1, conv_id % 2, n2, 2 FROM m WHERE k % 4 <> 3 AND k % 5 = 0),
c AS (SELECT h.*, count(*) OVER (PARTITION BY pair, mate) AS nh FROM h),
one AS (SELECT pair, 3 - mate AS mate, contig AS o_contig, pos AS o_pos FROM c WHERE nh = 1),
a AS (SELECT c.*, CASE WHEN o_contig = contig THEN abs(pos - o_pos) END AS apart FROM c LEFT JOIN one USING (pair, mate)),
r AS (SELECT *, row_number() OVER (PARTITION BY pair, mate ORDER BY apart NULLS LAST, CASE WHEN apart IS NOT NULL THEN pos END NULLS LAST, nm, contig, pos, strand) AS rank FROM a),
p AS (SELECT * FROM r WHERE rank = 1), s AS (SELECT pair, seq1 AS seq, 1 AS mate, n1 AS n FROM m UNION ALL SELECT pair, seq2, 2, n2 FROM m),
x AS (SELECT s.pair, s.mate, s.seq, s.n, r.contig, r.pos, r.strand, r.nm, r.nh, r.rank, o.contig AS oc, o.pos AS op, o.strand AS os, o.n AS onn FROM s LEFT JOIN (SELECT * FROM r WHERE nh = 1 OR rank = 1 UNION ALL SELECT * FROM r WHERE nh > 1 AND rank > 1) r ON r.pair = s.pair AND r.mate = s.mate LEFT JOIN p o ON o.pair = s.pair AND o.mate = 3 - s.mate),
y AS (SELECT *, coalesce(contig = oc AND CASE WHEN strand = '+' AND os = '-' THEN pos + 1 <= op + onn WHEN strand = '-' AND os = '+' THEN op + 1 <= pos + n ELSE false END AND greatest(pos + n, op + onn) - least(pos + 1, op + 1) + 1 BETWEEN 0 AND 600, false) AS proper, CASE strand WHEN '+' THEN pos + 1 ELSE pos + n END AS five, CASE os WHEN '+' THEN op + 1 ELSE op + onn END AS ofive FROM x)
SELECT 'q' || pair AS qname, CAST(1 + CASE WHEN proper THEN 2 ELSE 0 END + CASE WHEN contig IS NULL THEN 4 ELSE 0 END + CASE WHEN oc IS NULL THEN 8 ELSE 0 END + CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN os = '-' THEN 32 ELSE 0 END + 64 * mate + CASE WHEN rank > 1 THEN 256 ELSE 0 END AS INTEGER) AS flag,
coalesce('c' || coalesce(contig, oc), '*') AS rname, CAST(coalesce(pos, op, -1) + 1 AS BIGINT) AS pos, CAST(CASE WHEN nh = 1 THEN 60 ELSE 0 END AS INTEGER) AS mapq, CASE WHEN contig IS NULL THEN '*' ELSE n || 'M' END AS cigar,
CASE WHEN coalesce(oc, contig) IS NULL THEN '*' WHEN coalesce(oc, contig) = coalesce(contig, oc) THEN '=' ELSE 'c' || oc END AS rnext, CAST(coalesce(op, pos, -1) + 1 AS BIGINT) AS pnext, CAST(CASE WHEN contig = oc THEN ofive - five ELSE 0 END AS BIGINT) AS tlen, md5(CASE WHEN strand = '-' THEN {V.revcomp_sql('seq')} ELSE seq END) AS seq_md5, CAST(nm AS VARCHAR) AS nm, CAST(coalesce(nh, 0) AS VARCHAR) AS nh FROM y"""


@query("paired_records", PAIRED_SQL)
def paired_records(spark, sf):
    from strandloom.operators import paired

    c = F.col
    rows = V.mates(spark, sf).where((F.length("seq1") > 0) & (F.length("seq2") > 0)).withColumn("pair", c("conv_id").cast("long") * 4096 + c("k"))
    name = lambda i: F.concat(F.lit("q"), c("pair"), F.lit(f"/{i}"))
    zipped = rows.select(c("pair").alias("ordinal"), name(1).alias("id1"), "seq1", F.repeat(F.lit("I"), F.length("seq1")).alias("qual1"), name(2).alias("id2"), "seq2", F.repeat(F.lit("I"), F.length("seq2")).alias("qual2"))
    mates = paired.mates_of(zipped).withColumns({"good_start": F.lit(1), "good_stop": F.length("seq"), "discarded": F.lit(False), "contaminant": F.lit(None).cast("string")})
    ready = paired.admitted(mates, SearchConf(errors=2))
    n1, n2, conv = F.length("seq1").cast("long"), F.length("seq2").cast("long"), c("conv_id").cast("long")
    hit = lambda mate, pos, strand, nm, contig: (c("pair") * 2 + mate - 1, contig, pos, F.lit(strand), F.lit(nm))
    one = lambda where, h: rows.where(where).select(*(v.alias(k) for k, v in zip(("read_id", "contig_id", "pos", "strand", "nm"), h)))
    hits = one("k % 3 <> 2", hit(1, n1 + 100, "+", 1, conv % 3)).unionByName(one("k % 4 <> 3", hit(2, n2 + 150, "-", 2, conv % 3))).unionByName(one("k % 4 <> 3 and k % 5 = 0", hit(2, n2 + 5000, "+", 1, conv % 2)))
    names = spark.range(3).select(c("id").alias("contig_id"), F.concat(F.lit("c"), "id").alias("name"))
    out = paired.records(ready, hits, names, PairConf(0, 600), first=None)
    return out.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", F.md5("seq").alias("seq_md5"), c("tags")["NM"]["value"].alias("nm"), c("tags")["NH"]["value"].alias("nh"))


@query(
    "merged_read_groups",
    """WITH g AS (SELECT DISTINCT s_nationkey AS f, 'g' || s_suppkey % 10 AS id, 's' || s_nationkey % 3 AS sm FROM supplier),
v AS (SELECT id, sm, row_number() OVER (PARTITION BY id ORDER BY min(lpad(CAST(f AS VARCHAR), 4, '0')), sm) AS n FROM g GROUP BY id, sm)
SELECT s_suppkey AS k, CASE WHEN n = 1 THEN id ELSE id || '.' || substr(md5('{"SM":"' || sm || '"}'), 1, 16) END AS read_group FROM supplier JOIN v ON id = 'g' || s_suppkey % 10 AND sm = 's' || s_nationkey % 3""",
)
def merged_read_groups(spark, sf):
    """Suppliers as records of a file for each nation, whose read groups have the same names and other samples: the names after the files' headers are merged."""
    from strandloom.operators import headers

    own = table(spark, sf, "supplier").select(F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("file"), F.concat(F.lit("g"), F.col("s_suppkey") % 10).alias("id"), F.concat(F.lit("s"), F.col("s_nationkey") % 3).alias("sm"), F.col("s_suppkey").alias("k"))
    lines = own.select("file", F.lit("RG").alias("rec_type"), F.create_map(F.lit("ID"), "id", F.lit("SM"), "sm").alias("attrs"))
    tags = F.create_map(F.lit("RG"), F.struct(F.lit("Z").alias("code"), F.col("id").alias("value")))
    return headers.rewritten(own.select("file", "k", tags.alias("tags")), headers.renames(lines)).select("k", F.col("tags")["RG"]["value"].alias("read_group"))
