"""Queries that search reads in contigs, and what follows from the hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.config import SearchConf
from strandloom.functions import cigar as G
from strandloom.functions import sam
from strandloom.functions import seq as S
from strandloom.operators import dp, methyl, pileup, search, shards
from strandloom.plans import views as V
from strandloom.plans.registry import query

E4 = SearchConf(errors=4)
HITS = V.hits_sql(4)
BEST = HITS + ", best AS (SELECT *, min(nm) OVER (PARTITION BY read_id) AS least FROM hits)"
COLS = "read_id, contig_id, pos, strand, nm"


def _hits(spark, sf, errors=4):
    return search.hits(V.reads(spark, sf), V.prose(spark, sf), SearchConf(errors=errors))


@query("exact_join", V.hits_sql(0, "clean") + f" SELECT {COLS} FROM hits")
def exact_join(spark, sf):
    return search.search(V.clean_reads(spark, sf), V.prose(spark, sf), SearchConf(errors=0)).select(*COLS.split(", "))


@query("hamming_join_best", BEST + f" SELECT {COLS} FROM best WHERE nm = least")
def hamming_join_best(spark, sf):
    return search.search(V.reads(spark, sf), V.prose(spark, sf), E4).select(*COLS.split(", "))


@query("hamming_join_delta", V.hits_sql(4) + f", best AS (SELECT *, min(nm) OVER (PARTITION BY read_id) AS least FROM hits) SELECT {COLS} FROM best WHERE least <= 3 AND nm <= least + 1")
def hamming_join_delta(spark, sf):
    return search.search(V.reads(spark, sf), V.prose(spark, sf), SearchConf(errors=3, delta=1)).select(*COLS.split(", "))


@query("staged_join", BEST + f" SELECT {COLS} FROM best WHERE nm = least AND nm <= 2")
def staged_join(spark, sf):
    return search.staged(V.reads(spark, sf), V.prose(spark, sf), SearchConf(errors=2)).select(*COLS.split(", "))


@query("hit_count_nh", BEST + " SELECT read_id, count(*) AS nh, min(nm) AS nm FROM best WHERE nm = least GROUP BY read_id")
def hit_count_nh(spark, sf):
    return hamming_join_best(spark, sf).groupBy("read_id").agg(F.count("*").alias("nh"), F.min("nm").alias("nm"))


@query("error_strata", HITS + " SELECT read_id, string_agg(nm || ':' || n, ';' ORDER BY nm) AS xd FROM (SELECT r.read_id, r.nm, coalesce(h.n, 0) AS n FROM (SELECT read_id, unnest(range(min(nm), max(nm) + 1)) AS nm FROM hits GROUP BY read_id) r LEFT JOIN (SELECT read_id, nm, count(*) AS n FROM hits GROUP BY ALL) h ON r.read_id = h.read_id AND r.nm = h.nm) GROUP BY read_id")
def error_strata(spark, sf):
    return search.histogram(_hits(spark, sf)).select("read_id", sam.error_histogram(F.col("strata")).alias("xd"))


#: In two letters a base and what bisulfite makes of it are the same; pieces are looked for in these.
BISULFITE = (
    f"WITH {V.CONTIGS_SQL}, {V.CLEAN_SQL}, treated AS (SELECT read_id, translate(seq, 'C', 'T') AS seq FROM clean), {V.strands_sql('treated')}, "
    "forward AS (SELECT read_id, strand, translate(pattern, 'C', 'T') AS pattern FROM patterns WHERE strand = '+'), backward AS (SELECT read_id, strand, translate(pattern, 'G', 'A') AS pattern FROM patterns WHERE strand = '-'), "
    "ct AS (SELECT contig_id, translate(seq, 'C', 'T') AS seq FROM contigs), ga AS (SELECT contig_id, translate(seq, 'G', 'A') AS seq FROM contigs), "
    f"{V.pairs_sql('f', 'forward', 'ct', 2)}, {V.pairs_sql('b', 'backward', 'ga', 2)}, near AS (SELECT * FROM (SELECT * FROM f UNION ALL SELECT * FROM b) JOIN patterns USING (read_id, strand) JOIN contigs USING (contig_id) WHERE pos + length(pattern) <= length(seq)), "
    "hits AS (SELECT read_id, contig_id, pos, strand, list_sum(list_transform(range(1, length(pattern) + 1), lambda i: CASE WHEN substr(w, i, 1) = substr(pattern, i, 1) THEN 0 WHEN strand = '+' AND substr(w, i, 1) = 'C' AND substr(pattern, i, 1) = 'T' THEN 0 WHEN strand = '-' AND substr(w, i, 1) = 'G' AND substr(pattern, i, 1) = 'A' THEN 0 ELSE 1 END)) AS nm "
    "FROM (SELECT *, substr(seq, CAST(pos + 1 AS BIGINT), length(pattern)) AS w FROM near))"
)


def _bisulfite_reads(spark, sf):
    return V.clean_reads(spark, sf).select("read_id", F.translate("seq", "C", "T").alias("seq"))


def _bisulfite(spark, sf):
    return search.search(_bisulfite_reads(spark, sf), V.prose(spark, sf), SearchConf(errors=2, bisulfite=True))


@query("bisulfite_join", BISULFITE + ", best AS (SELECT *, min(nm) OVER (PARTITION BY read_id) AS least FROM hits WHERE nm <= 2) SELECT read_id, contig_id, pos, strand, CAST(nm AS INTEGER) AS nm FROM best WHERE nm = least")
def bisulfite_join(spark, sf):
    return _bisulfite(spark, sf).select(*COLS.split(", "))


def _contaminated(spark, sf):
    """Contigs in which a passage occurs: the passages are the contaminants."""
    return search.hits(V.clean_reads(spark, sf), V.prose(spark, sf), E4)


CONTAM = V.hits_sql(4, "clean")


@query("contamination_anti", CONTAM + " SELECT contig_id, length(seq) AS length FROM contigs WHERE contig_id NOT IN (SELECT contig_id FROM hits)")
def contamination_anti(spark, sf):
    return V.contigs(spark, sf).join(_contaminated(spark, sf).select("contig_id").distinct(), "contig_id", "left_anti").select("contig_id", F.length("seq").cast("long").alias("length"))


@query("contamination_tag", CONTAM + " SELECT contig_id, min(read_id) AS xc, count(*) AS n FROM hits GROUP BY contig_id")
def contamination_tag(spark, sf):
    return _contaminated(spark, sf).groupBy("contig_id").agg(F.min("read_id").alias("xc"), F.count("*").alias("n"))


@query("print_first_k", HITS + f" SELECT * FROM (SELECT {COLS}, row_number() OVER (PARTITION BY read_id ORDER BY nm, contig_id, pos, strand) AS hi, count(*) OVER (PARTITION BY read_id) AS nh FROM hits) WHERE hi <= 2")
def print_first_k(spark, sf):
    return search.numbered(_hits(spark, sf), 2).select(*COLS.split(", "), F.col("hi").cast("long").alias("hi"), "nh")


@query("unique_choice_md5", HITS + f" SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY md5('1|' || read_id || '|' || contig_id || '|' || pos || '|' || strand)) AS rn FROM hits) WHERE rn = 1")
def unique_choice_md5(spark, sf):
    return search.chosen(_hits(spark, sf)).select(*COLS.split(", "))


@query("set_union_strands", HITS + " SELECT DISTINCT contig_id, pos FROM (SELECT contig_id, pos FROM hits WHERE strand = '+' UNION ALL SELECT contig_id, pos FROM hits WHERE strand = '-')")
def set_union_strands(spark, sf):
    return search.places(_hits(spark, sf))


@query("shard_min_merge", HITS + " SELECT read_id, min(nm) AS nm, count(*) FILTER (nm = least) AS n FROM (SELECT *, min(nm) OVER (PARTITION BY read_id) AS least FROM hits) GROUP BY read_id")
def shard_min_merge(spark, sf):
    return shards.final(shards.partial(_hits(spark, sf).withColumn("shard", F.col("contig_id") % 4)))


@query("shard_carried_budget", BEST + f" SELECT {COLS} FROM best WHERE nm = least")
def shard_carried_budget(spark, sf):
    """hamming_join_best over four shards of contigs, each searched with what the shards before found."""
    return shards.carried(V.reads(spark, sf), V.contigs(spark, sf).withColumn("shard", F.col("contig_id") % 4), E4)[0].select(*COLS.split(", "))


def _records(spark, sf):
    """Hits as records: soft-clipped by five bases on each side."""
    reads_, found = V.reads(spark, sf), _hits(spark, sf)
    rows = found.join(reads_, "read_id")
    seq = F.when(F.col("strand") == "+", F.col("seq")).otherwise(S.revcomp(F.col("seq")))
    return rows.select(F.concat(F.lit("r"), F.col("read_id")).alias("qname"), F.when(F.col("strand") == "-", 16).otherwise(0).alias("flag"), "contig_id", (F.col("pos") + 5).alias("pos"), G.build(F.length("seq") - 10, F.lit(5), F.lit(5)).alias("cigar"), seq.alias("seq"))


@query("pileup_depth", HITS + " SELECT contig_id, ref, count(*) AS depth FROM (SELECT contig_id, pos + unnest(range(5, length(seq) - 5)) AS ref FROM hits JOIN reads USING (read_id)) GROUP BY ALL")
def pileup_depth(spark, sf):
    return pileup.depth(_records(spark, sf)).select("contig_id", "ref", "depth")


@query(
    "pileup_entries",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS contig_id, o_custkey % 1000 AS p, o_custkey % 7 + 1 AS a, o_orderkey % 3 AS b, o_orderkey % 5 + 1 AS c, o_custkey % 3 AS d, o_orderkey % 4 + 1 AS e, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM orders),
r AS (
SELECT k, contig_id, s, p + i AS ref, 3 + i AS qpos, CASE WHEN i = a - 1 THEN b ELSE 0 END AS indel, i = 0 AS is_head, false AS is_tail FROM (SELECT *, unnest(range(0, a)) AS i FROM o)
UNION ALL SELECT k, contig_id, s, p + a + i, 3 + a + b + i, CASE WHEN i = c - 1 THEN -d ELSE 0 END, false, false FROM (SELECT *, unnest(range(0, c)) AS i FROM o)
UNION ALL SELECT k, contig_id, s, p + a + c + i, NULL, 0, false, false FROM (SELECT *, unnest(range(0, d)) AS i FROM o)
UNION ALL SELECT k, contig_id, s, p + a + c + d + i, 3 + a + b + c + i, 0, false, i = e - 1 FROM (SELECT *, unnest(range(0, e)) AS i FROM o))
SELECT 'r' || k AS qname, contig_id, ref, qpos, qpos IS NULL AS is_del, substr(s, CAST(qpos + 1 AS BIGINT), 1) AS base, CAST(indel AS INTEGER) AS indel, is_head, is_tail FROM r""",
)
def pileup_entries(spark, sf):
    """Orders as alignments with a clip, an insertion and a deletion: what each position has of each."""
    o, c = V.table(spark, sf, "orders"), F.col
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    cigar = F.concat(F.lit("3S"), part(c("o_custkey") % 7 + 1, "M"), part(c("o_orderkey") % 3, "I"), part(c("o_orderkey") % 5 + 1, "M"), part(c("o_custkey") % 3, "D"), part(c("o_orderkey") % 4 + 1, "M"))
    seq = F.translate(F.md5(c("o_orderkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = o.select(F.concat(F.lit("r"), "o_orderkey").alias("qname"), F.lit(0).alias("flag"), (c("o_orderkey") % 4).alias("contig_id"), (c("o_custkey") % 1000).alias("pos"), cigar.alias("cigar"), seq.alias("seq"))
    return pileup.columns(rows).select("qname", "contig_id", "ref", "qpos", "is_del", "base", "indel", "is_head", "is_tail")


@query("idxstats", HITS + " SELECT c.contig_id, length(c.seq) AS length, count(h.read_id) AS mapped, CAST(0 AS BIGINT) AS unmapped FROM contigs c LEFT JOIN hits h ON c.contig_id = h.contig_id GROUP BY ALL")
def idxstats(spark, sf):
    return pileup.idxstats(_records(spark, sf), V.contigs(spark, sf).select("contig_id", F.length("seq").cast("long").alias("length")))


@query("sam_text", HITS + " SELECT 'r' || read_id || chr(9) || CASE strand WHEN '-' THEN 16 ELSE 0 END || chr(9) || contig_id || chr(9) || (pos + 1) || chr(9) || CASE WHEN nh = 1 THEN 60 ELSE 0 END || chr(9) || length(seq) || 'M' || chr(9) || '*' || chr(9) || 0 || chr(9) || 0 || chr(9) || seq || chr(9) || '*' || chr(9) || 'NH:i:' || nh || chr(9) || 'NM:i:' || nm AS value FROM (SELECT h.read_id, strand, contig_id, pos, nm, CASE strand WHEN '+' THEN r.seq ELSE " + V.revcomp_sql("r.seq") + " END AS seq, count(*) OVER (PARTITION BY h.read_id) AS nh FROM hits h JOIN reads r ON h.read_id = r.read_id)")
def sam_text(spark, sf):
    from strandloom.sources.sam import text_of

    rows = search.numbered(_hits(spark, sf)).join(V.reads(spark, sf), "read_id")
    seq = F.when(F.col("strand") == "+", F.col("seq")).otherwise(S.revcomp(F.col("seq")))
    null = F.lit(None)
    fields = {"qname": F.concat(F.lit("r"), F.col("read_id")), "flag": sam.flag(reverse=F.col("strand") == "-"), "rname": F.col("contig_id").cast("string"), "pos": F.col("pos") + 1, "mapq": sam.mapq(F.col("nh")), "cigar": F.concat(F.length("seq").cast("string"), F.lit("M")), "rnext": null.cast("string"), "pnext": null.cast("long"), "tlen": null.cast("long"), "seq": seq, "qual": null.cast("string"), "tags": F.create_map(F.lit("NH"), F.col("nh").cast("string"), F.lit("NM"), F.col("nm").cast("string"))}
    return text_of(rows.select(*(v.alias(k) for k, v in fields.items())))


PROFILE = BISULFITE + ", kept AS (SELECT *, min(nm) OVER (PARTITION BY read_id) AS least FROM hits WHERE nm <= 2), obs AS (SELECT k.contig_id, k.strand, k.pos + i - 1 AS ref, substr(c.seq, CAST(k.pos + i AS BIGINT), 1) AS r, substr(k.pattern, i, 1) AS b FROM (SELECT *, unnest(range(1, length(pattern) + 1)) AS i FROM kept JOIN patterns USING (read_id, strand) WHERE nm = least) k JOIN contigs c ON c.contig_id = k.contig_id), profile AS (SELECT contig_id, ref, strand, least(255, count(*) FILTER (b = r)) AS c_cnt, least(255, count(*) FILTER (b <> r)) AS t_cnt FROM obs WHERE (strand = '+' AND r = 'C' AND b IN ('C', 'T')) OR (strand = '-' AND r = 'G' AND b IN ('G', 'A')) GROUP BY ALL)"


def _profile(spark, sf):
    return methyl.profile(methyl.observed(_bisulfite(spark, sf), _bisulfite_reads(spark, sf), V.contigs(spark, sf)))


@query("methyl_profile", PROFILE + " SELECT contig_id, ref, strand, c_cnt, t_cnt, round(CASE WHEN c_cnt + t_cnt = 0 THEN 0 ELSE c_cnt / (c_cnt + t_cnt) END, 6) AS level FROM profile")
def methyl_profile(spark, sf):
    return _profile(spark, sf).withColumn("level", F.round(methyl.level(F.col("c_cnt"), F.col("t_cnt")), 6))


@query(
    "methyl_report",
    PROFILE + """, x AS (SELECT p.*, CASE WHEN strand = '+' THEN CASE WHEN substr(seq, CAST(ref + 2 AS BIGINT), 1) = 'G' THEN 'CG' WHEN substr(seq, CAST(ref + 3 AS BIGINT), 1) = 'G' THEN 'CHG' ELSE 'CHH' END
ELSE CASE WHEN ref >= 1 AND substr(seq, CAST(ref AS BIGINT), 1) = 'C' THEN 'CG' WHEN ref >= 2 AND substr(seq, CAST(ref - 1 AS BIGINT), 1) = 'C' THEN 'CHG' ELSE 'CHH' END END AS context FROM profile p JOIN contigs c ON p.contig_id = c.contig_id)
SELECT contig_id, ref + 1 AS start, ref + 1 AS "end", context || ':' || (c_cnt + t_cnt) AS ctx_cov, round(c_cnt / (c_cnt + t_cnt), 6) AS level, strand FROM x""",
)
def methyl_report(spark, sf):
    return methyl.report(_profile(spark, sf), V.contigs(spark, sf))


@query("methyl_resolve_loop")
def methyl_resolve_loop(spark, sf):
    from strandloom.config import MethylConf

    return methyl.resolve(_bisulfite(spark, sf), _bisulfite_reads(spark, sf), V.contigs(spark, sf), MethylConf(min_cov=1, max_cov=2), _shared(spark, "cycles"))


#: The dynamic programme of banded alignments in SQL: a row of scores for each base of a read, within five of the diagonal of a place. "." is beyond the contig.
INDELS = (
    f"WITH RECURSIVE {V.CONTIGS_SQL}, {V.CLEAN_SQL}, cut AS (SELECT read_id, substr(seq, 1, 30) || substr(seq, 33) AS seq FROM clean), {V.strands_sql('cut')}, {V.pairs_sql('plain', 'patterns', 'contigs', 1)}, "
    "ungapped AS (SELECT DISTINCT read_id FROM plain JOIN patterns USING (read_id, strand) JOIN contigs USING (contig_id) WHERE pos + length(pattern) <= length(seq) AND hamming(substr(seq, CAST(pos + 1 AS BIGINT), length(pattern)), pattern) <= 1), "
    "open_ AS (SELECT * FROM patterns WHERE read_id NOT IN (SELECT read_id FROM ungapped)), "
    "width AS (SELECT min(length(pattern)) // 7 AS k FROM open_), "
    "q AS (SELECT read_id, strand, pattern, k, j * (length(pattern) // 7) AS off, substr(pattern, CAST(j * (length(pattern) // 7) + 1 AS BIGINT), CAST(k AS BIGINT)) AS key FROM (SELECT *, unnest(range(0, 7)) AS j FROM open_), width), "
    "w AS (SELECT contig_id, x, substr(seq, CAST(x + 1 AS BIGINT), CAST(k AS BIGINT)) AS key FROM (SELECT contig_id, seq, k, unnest(range(0, greatest(length(seq) - k + 1, 0))) AS x FROM contigs, (SELECT DISTINCT k FROM q))), "
    "c AS MATERIALIZED (SELECT DISTINCT read_id, strand, pattern, contig_id, x - off AS pos FROM q JOIN w USING (key) WHERE x - off >= -5), "
    "t AS MATERIALIZED (SELECT read_id, strand, pattern, contig_id, length(pattern) AS n, rpad(repeat('.', CAST(greatest(5 - pos, 0) AS BIGINT)) || substr(seq, CAST(greatest(pos - 5, 0) + 1 AS BIGINT), length(pattern) + 10 - greatest(5 - pos, 0)), CAST(length(pattern) + 10 AS INTEGER), '.') AS t FROM c JOIN contigs USING (contig_id) WHERE greatest(pos - 5, 0) < length(seq)), "
    "u AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT read_id, strand, pattern, contig_id, n, t FROM t)), "
    "r AS (SELECT id, 0 AS i, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS s FROM u UNION ALL SELECT id, i + 1, list_transform(range(1, 12), lambda d: CASE WHEN substr(w, d, 1) = '.' THEN base[d] ELSE list_max(list_transform(range(greatest(1, dots), d + 1), lambda j: base[j] - 2 * (d - j))) END) FROM "
    "(SELECT id, i, w, length(w) - length(ltrim(w, '.')) AS dots, list_transform(range(1, 12), lambda d: greatest(CASE WHEN substr(w, d, 1) = '.' THEN -1000000 ELSE s[d] + CASE WHEN substr(w, d, 1) = b THEN 1 ELSE -1 END END, CASE WHEN d < 11 THEN s[d + 1] - 2 ELSE -1000000 END)) AS base FROM "
    "(SELECT r.id, r.i, r.s, substr(u.t, r.i + 1, 11) AS w, substr(u.pattern, r.i + 1, 1) AS b FROM r JOIN u ON u.id = r.id WHERE r.i < u.n))), "
    "ends AS (SELECT u.read_id, u.contig_id, u.strand, max(list_max(r.s)) AS score, any_value(u.n) AS n FROM r JOIN u ON u.id = r.id WHERE r.i = u.n GROUP BY ALL) "
    "SELECT read_id, contig_id, strand, CAST(score AS INTEGER) AS score FROM (SELECT *, max(score) OVER (PARTITION BY read_id) AS top FROM ends) WHERE score = top AND score >= n - 17"
)


@query("indel_search", INDELS)
def indel_search(spark, sf):
    """Passages with two bases taken out of the middle: found by a piece and aligned with a deletion."""
    cut = V.clean_reads(spark, sf).select("read_id", F.concat(F.substring("seq", 1, 30), F.substr("seq", F.lit(33))).alias("seq"))
    return dp.indel_search(cut, V.contigs(spark, sf), SearchConf(errors=1, indels=True, indels_max=5)).select("read_id", "contig_id", "strand", "score").distinct()


ENDS = "ends AS (SELECT read_id, left(seq, 25) AS a, right(seq, 25) AS b, length(seq) AS n FROM tiles WHERE length(seq) >= 50)"
GAPPED = f"WITH {V.CONTIGS_SQL}, {V.passages_sql('tiles', 90)}, {ENDS}, pat AS (SELECT read_id, '+' AS strand, a, b FROM ends UNION ALL SELECT read_id, '-', {V.revcomp_sql('b')}, {V.revcomp_sql('a')} FROM ends), w AS MATERIALIZED (SELECT contig_id, p AS pos, substr(seq, p + 1, 25) AS w FROM (SELECT contig_id, seq, unnest(range(0, greatest(length(seq) - 24, 0))) AS p FROM contigs))"


@query("gapped_range_join", GAPPED + ", l AS MATERIALIZED (SELECT read_id, strand, contig_id, pos FROM w JOIN pat ON w = a), r AS MATERIALIZED (SELECT read_id, strand, contig_id, pos FROM w JOIN pat ON w = b) SELECT l.read_id, l.contig_id, l.strand, l.pos, r.pos AS pos2, r.pos - l.pos - 25 AS gap FROM l JOIN r ON l.read_id = r.read_id AND l.strand = r.strand AND l.contig_id = r.contig_id AND r.pos - l.pos - 25 BETWEEN 0 AND 100")
def gapped_range_join(spark, sf):
    """Two exact ends of each stretch of 90 bases of the passages, with up to 100 bases between them."""
    ends = V.passages(spark, sf, 90).where(F.length("seq") >= 50).select("read_id", F.left("seq", F.lit(25)).alias("a"), F.right("seq", F.lit(25)).alias("b"))
    both = ends.select("read_id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), "a", "b"), F.struct(F.lit("-").alias("strand"), S.revcomp(F.col("b")).alias("a"), S.revcomp(F.col("a")).alias("b")))).alias("e")).select("read_id", "e.*")
    name = F.concat_ws("|", "read_id", "strand").alias("read_id")
    side = lambda c: search.hits(both.select(name, F.col(c).alias("seq")), V.contigs(spark, sf), SearchConf(errors=0)).where("strand = '+'").select(F.col("read_id").alias("key"), "contig_id", "pos")
    left = side("a").withColumn("from", F.col("pos") + 25)
    met = search.range_join(left, side("b").withColumnRenamed("pos", "pos2"), ["key", "contig_id"], "from", "pos2", 100)
    return met.select(F.split("key", "\\|")[0].cast("long").alias("read_id"), "contig_id", F.split("key", "\\|")[1].alias("strand"), "pos", "pos2", (F.col("pos2") - F.col("from")).alias("gap"))


SPLICED = (
    f"WITH {V.CONTIGS_SQL}, {V.passages_sql('tiles', 100)}, cut AS (SELECT read_id, left(seq, 30) || right(seq, 30) AS seq FROM tiles WHERE length(seq) >= 60), {V.strands_sql('cut')}, "
    f"heads AS (SELECT read_id, strand, left(pattern, 20) AS pattern FROM patterns), tails AS (SELECT read_id, strand, right(pattern, 20) AS pattern FROM patterns), {V.pairs_sql('h', 'heads', 'contigs', 1)}, {V.pairs_sql('e', 'tails', 'contigs', 1)}, "
    "l AS MATERIALIZED (SELECT h.* FROM h JOIN heads USING (read_id, strand) JOIN contigs USING (contig_id) WHERE pos + 20 <= length(seq) AND hamming(substr(seq, CAST(pos + 1 AS BIGINT), 20), pattern) <= 1), "
    "r AS MATERIALIZED (SELECT e.* FROM e JOIN tails USING (read_id, strand) JOIN contigs USING (contig_id) WHERE pos + 20 <= length(seq) AND hamming(substr(seq, CAST(pos + 1 AS BIGINT), 20), pattern) <= 1), "
    "m AS (SELECT l.read_id, l.strand, l.contig_id, l.pos AS pos, r.pos + 20 - l.pos - length(pattern) AS gap, pattern, length(pattern) AS n, seq FROM l JOIN r ON l.read_id = r.read_id AND l.strand = r.strand AND l.contig_id = r.contig_id JOIN patterns p ON p.read_id = l.read_id AND p.strand = l.strand JOIN contigs c ON c.contig_id = l.contig_id WHERE r.pos + 20 - l.pos - length(pattern) BETWEEN 0 AND 100), "
    "s AS (SELECT *, hamming(substr(seq, CAST(pos + 1 AS BIGINT), c), left(pattern, c)) AS nm, hamming(substr(seq, CAST(pos + gap + c + 1 AS BIGINT), n - c), right(pattern, n - c)) AS nm2 FROM (SELECT *, unnest(range(20, n - 19)) AS c FROM m)), "
    "b AS (SELECT read_id, strand, contig_id, pos, gap, min(struct_pack(total := nm + nm2, cut := c, nm := nm, nm2 := nm2)) AS best FROM s GROUP BY ALL) "
    "SELECT read_id, contig_id, strand, pos, CAST(pos + best.cut + gap AS BIGINT) AS pos2, CAST(best.cut AS INTEGER) AS len1, CAST(best.nm AS INTEGER) AS nm, CAST(best.nm2 AS INTEGER) AS nm2, gap FROM (SELECT *, min(best.total) OVER (PARTITION BY read_id) AS least FROM b WHERE best.total <= 2) WHERE best.total = least"
)


@query("gapped_search", SPLICED)
def gapped_search(spark, sf):
    """The first and last 30 bases of each stretch of 100 of the passages, looked for as two parts with a gap."""
    rows = V.passages(spark, sf, 100).where(F.length("seq") >= 60)
    return search.gapped(rows.select("read_id", F.concat(F.left("seq", F.lit(30)), F.right("seq", F.lit(30))).alias("seq")), V.contigs(spark, sf), SearchConf(errors=2, gap=True))


@query("screened_reads", V.hits_sql(4) + ", best AS (SELECT *, min(nm) OVER (PARTITION BY read_id) AS least FROM hits) SELECT r.read_id, min(contig_id) AS contaminant FROM reads r LEFT JOIN (SELECT * FROM best WHERE nm = least) b ON r.read_id = b.read_id GROUP BY r.read_id")
def screened_reads(spark, sf):
    """Reads that are contaminated by a contig, with it, and those that go on, with null."""
    rest, found = search.screened(V.reads(spark, sf), V.prose(spark, sf), E4)
    return found.select("read_id", "contaminant").unionByName(rest.select("read_id", F.lit(None).cast("long").alias("contaminant")))


@query("hits_by_position", HITS + " SELECT read_id, contig_id, pos, strand, row_number() OVER (PARTITION BY read_id ORDER BY pos, contig_id, strand) AS place FROM hits")
def hits_by_position(spark, sf):
    from pyspark.sql import Window

    return _hits(spark, sf).select("read_id", "contig_id", "pos", "strand", F.row_number().over(Window.partitionBy("read_id").orderBy("pos", "contig_id", "strand")).cast("long").alias("place"))


def _shared(spark, what: str) -> str:
    """A new folder in the one that all executors share."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{folder}/{what}-{uuid.uuid4().hex}"


@query("stored_index_search", BEST + f" SELECT {COLS} FROM best WHERE nm = least")
def stored_index_search(spark, sf):
    """hamming_join_best over an index that was written first."""
    from strandloom.operators import seeds

    path = _shared(spark, "index")
    seeds.write_search_index(V.contigs(spark, sf), path, 12, reach=V.READ)
    return search.indexed(V.reads(spark, sf), seeds.read_search_index(spark, path), E4).select(*COLS.split(", "))


@query("ball_search", BEST + f" SELECT {COLS} FROM best WHERE nm = least")
def ball_search(spark, sf):
    """hamming_join_best over an index of seeds that are too wide for a piece for each difference: reads of 60 bases have three pieces of 16, and with four differences one piece has one at most."""
    from strandloom.operators import seeds

    path = _shared(spark, "index")
    seeds.write_search_index(V.contigs(spark, sf), path, 16, reach=V.READ)
    return search.indexed(V.reads(spark, sf), seeds.read_search_index(spark, path), E4).select(*COLS.split(", "))


@query("bam_round_trip", HITS + f" SELECT 'r' || h.read_id AS qname, CASE strand WHEN '-' THEN 16 ELSE 0 END AS flag, CAST(contig_id AS VARCHAR) AS rname, pos + 1 AS pos, length(r.seq) || 'M' AS cigar, CASE strand WHEN '+' THEN r.seq ELSE {V.revcomp_sql('r.seq')} END AS seq, CAST(nm AS VARCHAR) AS nm FROM hits h JOIN reads r ON h.read_id = r.read_id")
def bam_round_trip(spark, sf):
    """Hits as records, written as BAM by all tasks and read back."""
    from strandloom.sources import sam as files

    records, header = _bam_records(spark, sf)
    path = _shared(spark, "bam")
    files.write_bam(records, header, path)
    return files.read_bam(spark, path).select("qname", "flag", "rname", "pos", "cigar", "seq", F.col("tags")["NM"]["value"].alias("nm"))


def _bam_records(spark, sf):
    """Hits as BAM records, searched once, and the contigs that they lie in."""
    from strandloom.operators.kept import kept

    found = kept(_hits(spark, sf).join(V.reads(spark, sf), "read_id"), "hits")
    null = F.lit(None)
    fields = {"qname": F.concat(F.lit("r"), "read_id"), "flag": sam.flag(reverse=F.col("strand") == "-"), "rname": F.col("contig_id").cast("string"), "pos": F.col("pos") + 1, "mapq": F.lit(0), "cigar": F.concat(F.length("seq").cast("string"), F.lit("M")), "rnext": F.lit("*"), "pnext": F.lit(0).cast("long"), "tlen": F.lit(0).cast("long"), "seq": F.when(F.col("strand") == "+", F.col("seq")).otherwise(S.revcomp(F.col("seq"))), "qual": null.cast("string"), "tags": F.create_map(F.lit("NM"), F.col("nm").cast("string"))}
    named = found.select("contig_id").distinct().join(V.contigs(spark, sf), "contig_id").select(F.col("contig_id").cast("string").alias("name"), F.length("seq").alias("length"))
    return found.select(*(v.alias(k) for k, v in fields.items())), [(r.name, r.length) for r in named.collect()]  # the header of a file


@query("bam_region_index", HITS + " SELECT 'r' || read_id AS qname, CAST(contig_id AS VARCHAR) AS rname, pos + 1 AS pos, CASE strand WHEN '-' THEN 16 ELSE 0 END AS flag FROM hits h JOIN contigs c USING (contig_id) JOIN reads r USING (read_id) WHERE pos < length(c.seq) * 3 // 4 AND pos + length(r.seq) > length(c.seq) // 4")
def bam_region_index(spark, sf):
    """Hits written as one sorted BAM file with its index, and the records of the middle half of each contig read through the index."""
    from strandloom.sources import bai

    records, header = _bam_records(spark, sf)
    path = _shared(spark, "sorted")
    bai.write_sorted_bam(records, header, path)
    bai.joined(spark, path, f"{path}.bam")
    index = bai.index_of(spark, f"{path}.bam")
    bai.write_bai(index, f"{path}.bam", f"{path}.bam.bai")
    return bai.in_regions(spark, f"{path}.bam", f"{path}.bam.bai", [(n, size // 4, size * 3 // 4) for n, size in header]).select("qname", "rname", "pos", "flag")


@query("typed_tag_round_trip", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders)
SELECT 'order/' || k AS qname, 'BC:Z:' || lpad(CAST(k AS VARCHAR), 12, '0') || chr(9) || 'XA:A:' || s || chr(9) || 'XI:i:' || (c - 500) || chr(9) || 'XF:f:' || ['0', '0.25', '0.5', '0.75'][k % 4 + 1] || chr(9) || 'XB:B:S,' || c % 65536 || ',' || k % 100 || chr(9) || 'XH:H:1AFF' || chr(9) || 'RG:Z:' || c AS tags FROM o""")
def typed_tag_round_trip(spark, sf):
    """Orders as records without a place, whose tags are of all kinds: digits that are text, letters, numbers and arrays; through BAM written by all tasks and read in splits, back to text."""
    from strandloom.sources import sam as files

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    quarter = F.element_at(F.array(*map(F.lit, ("0", "0.25", "0.5", "0.75"))), (k % 4 + 1).cast("int"))
    tags = F.concat_ws("\t", text("BC:Z:", F.lpad(k.cast("string"), 12, "0")), text("XA:A:", F.col("o_orderstatus")), text("XI:i:", c - 500), text("XF:f:", quarter), text("XB:B:S,", c % 65536, ",", k % 100), F.lit("XH:H:1AFF"), text("RG:Z:", c))
    line = F.concat_ws("\t", text("order/", k), *map(F.lit, ("4", "*", "0", "0", "*", "*", "0", "0", "*", "*")), tags)
    path = _shared(spark, "bam")
    files.write_bam(files.records_of(V.table(spark, sf, "orders").select(line.alias("value"))), [], path, "@CO\tordres à plat\n")
    return files.text_of(files.read_bam(spark, path)).select(F.split("value", "\t")[0].alias("qname"), F.array_join(F.slice(F.split("value", "\t"), 12, 99), "\t").alias("tags"))


@query("fasta_index_fetch", f"WITH {V.CONTIGS_SQL} SELECT CAST(contig_id AS VARCHAR) AS name, substr(seq, CAST(length(seq) // 4 + 1 AS BIGINT), CAST(length(seq) * 3 // 4 - length(seq) // 4 AS BIGINT)) AS seq FROM contigs")
def fasta_index_fetch(spark, sf):
    """Contigs written as FASTA, indexed, and the middle half of each read by its bytes."""
    from strandloom.sources import fai, fasta

    path = _shared(spark, "fasta")
    named = V.contigs(spark, sf).select(F.col("contig_id").cast("string").alias("name"), F.lit("").alias("comment"), "seq")
    fasta.write_fasta(named, path)
    index = fai.index_of(spark, f"{path}/*.txt")
    return fai.fetch(index, index.select("name", F.expr("length div 4").alias("begin"), F.expr("length * 3 div 4").alias("end"))).select("name", "seq")
