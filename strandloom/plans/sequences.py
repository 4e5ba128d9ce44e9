"""Queries over single sequences: recoding, masks, trimming, seeds, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.config import TrimConf
from strandloom.functions import seq as S
from strandloom.operators import contigs as C
from strandloom.operators import methyl, seeds, trim
from strandloom.plans import views as V
from strandloom.plans.registry import query, table
from strandloom.sources import fastq

PASSAGE = f"SELECT item_id, {V.dna_sql('text')} AS s FROM benchmark"
NTEXT = "translate(regexp_replace(lower(text),'[^a-z]','','g'),'abcdefghijklmnopqrstuvwxyz','ACGTACGTANGTACGTNCGTACGNAN')"


@query("scan_contigs", f"WITH {V.CONTIGS_SQL} SELECT contig_id, length(seq) AS length, CAST(coalesce(sum(length(seq) + 1) OVER (ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS global_start, md5(seq) AS seq_md5 FROM contigs")
def scan_contigs(spark, sf):
    return C.with_offsets(V.contigs(spark, sf)).select("contig_id", "length", "global_start", F.md5("seq").alias("seq_md5"))


@query("revcomp", f"SELECT item_id, {V.revcomp_sql('s')} AS rc, reverse(s) AS backwards FROM ({PASSAGE})")
def revcomp(spark, sf):
    s = S.dna(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", S.revcomp(s).alias("rc"), F.reverse(s).alias("backwards"))


@query("iupac_complement", "SELECT item_id, translate(upper(regexp_replace(text,'[^A-Za-z]','','g')),'ACGTURYMKSWBVDHN','TGCAAYRKMSWVBHDN') AS comp FROM benchmark")
def iupac_complement(spark, sf):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf, "benchmark").select("item_id", S.complement(letters).alias("comp"))


@query("lowercase_mask", f"SELECT item_id, lower(substr(s,1,10)) || substr(s,11,40) || lower(substr(s,51)) AS masked, replace(replace(s,'A','N'),'N','n') AS small_n FROM ({PASSAGE})")
def lowercase_mask(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", S.dna(F.col("text")).alias("s"))
    return rows.select("item_id", S.masked(F.col("s"), F.lit(11), F.lit(50), F.lit(False)).alias("masked"), S.lower_n(F.replace("s", F.lit("A"), F.lit("N"))).alias("small_n"))


def _n_text(spark, sf):
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, sf, "documents").select("doc_id", F.translate(letters, S.LETTERS, "ACGTACGTANGTACGTNCGTACGNAN").alias("s"))


@query("n_content_filter", f"SELECT doc_id, length(s) - length(replace(s,'N','')) AS n FROM (SELECT doc_id, {NTEXT} AS s FROM documents) WHERE length(s) > 0 AND length(s) - length(replace(s,'N','')) <= CAST(round(length(s) / 15.0) AS INTEGER)")
def n_content_filter(spark, sf):
    s = F.col("s")
    return _n_text(spark, sf).where((F.length(s) > 0) & (S.n_count(s) <= S.error_budget(F.length(s)))).select("doc_id", S.n_count(s).alias("n"))


@query("auto_error_budget", f"WITH {V.CONTIGS_SQL} SELECT contig_id, CAST(round(length(seq) / 15.0) AS INTEGER) AS max_errors, CAST(least(greatest(ceil(round(ln(length(seq)) / ln(4), 9)), 10), 15) AS INTEGER) AS k FROM contigs")
def auto_error_budget(spark, sf):
    return V.contigs(spark, sf).select("contig_id", S.error_budget(F.length("seq")).alias("max_errors"), S.index_width(F.length("seq")).alias("k"))


@query(
    "mott_trim_events",
    """WITH q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(least(41, floor(value)) AS INTEGER) AS q FROM events),
f AS (SELECT *, min(CASE WHEN q >= 20 THEN i END) OVER (PARTITION BY user_id) AS first FROM q),
s AS (SELECT *, sum(q - 20) OVER (PARTITION BY user_id ORDER BY i) AS s FROM f WHERE i >= first),
a AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY i)) AS a FROM s),
l AS (SELECT *, first_value(i) OVER (PARTITION BY user_id ORDER BY a DESC, i DESC) AS last FROM a)
SELECT user_id, min(i) AS first_pos, max(i) AS last_pos, CAST(sum(q) AS BIGINT) AS total FROM l WHERE i <= last GROUP BY user_id""",
)
def mott_trim_events(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.least(F.lit(41), F.floor("value")).cast("int").alias("q"))
    found = trim.region_of_rows(rows, "user_id", ["ts", "event_id"], "q", 20)
    return found.select("user_id", F.col("first_pos").cast("long").alias("first_pos"), F.col("last_pos").cast("long").alias("last_pos"), "total")


QUALS = f"SELECT item_id, s, array_to_string(list_transform(range(1, length(s) + 1), lambda i: chr(CAST(33 + (ascii(substr(s, i, 1)) * (i + 3) + item_id) % 42 AS INTEGER))), '') AS qual FROM ({PASSAGE})"


def _quals(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", S.dna(F.col("text")).alias("seq")).where(F.length("seq") > 0)
    return rows.withColumn("qual", V.quality(F.col("seq"), F.col("item_id")))


@query(
    "mott_trim_reads",
    f"""WITH q AS (SELECT item_id, unnest(range(1, length(s) + 1)) AS i, s, qual FROM ({QUALS}) WHERE length(s) > 0),
v AS (SELECT item_id, i, ascii(substr(qual, i, 1)) - 33 AS q FROM q),
f AS (SELECT *, min(CASE WHEN q >= 20 THEN i END) OVER (PARTITION BY item_id) AS first FROM v),
s AS (SELECT *, sum(q - 20) OVER (PARTITION BY item_id ORDER BY i) AS s FROM f WHERE i >= first),
a AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY item_id ORDER BY i)) AS a FROM s),
l AS (SELECT *, first_value(i) OVER (PARTITION BY item_id ORDER BY a DESC, i DESC) AS last FROM a)
SELECT item_id, CAST(min(i) AS INTEGER) AS good_start, CAST(max(i) AS INTEGER) AS good_stop FROM l WHERE i <= last GROUP BY item_id HAVING max(i) - min(i) + 1 >= 25 AND sum(q) // (max(i) - min(i) + 1) >= 20""",
)
def mott_trim_reads(spark, sf):
    return trim.trim(_quals(spark, sf), TrimConf()).where(~F.col("discarded")).select("item_id", "good_start", "good_stop")


@query("good_region_slice", f"SELECT item_id, substr(s, 6, 25) AS part, substr(qual, 6, 25) AS qual_part FROM ({QUALS}) WHERE length(s) > 0")
def good_region_slice(spark, sf):
    part = lambda c: S.good_part(F.col(c), F.lit(6), F.lit(30), F.lit(False))
    return _quals(spark, sf).select("item_id", part("seq").alias("part"), part("qual").alias("qual_part"))


@query("phred_decode", f"SELECT item_id, array_to_string(list_transform(range(1, length(qual) + 1), lambda i: CAST(ascii(substr(qual, i, 1)) - 33 AS VARCHAR)), ',') AS q, array_to_string(list_transform(range(1, length(qual) + 1), lambda i: chr(ascii(substr(qual, i, 1)) + 31)), '') AS shifted FROM ({QUALS}) WHERE length(s) > 0")
def phred_decode(spark, sf):
    q = F.array_join(F.transform(S.phred(F.col("qual")), lambda x: x.cast("string")), ",")
    return _quals(spark, sf).select("item_id", q.alias("q"), S.shift_quality(F.col("qual"), 31).alias("shifted"))


@query(
    "quality_encoding_sniff",
    f"""WITH c AS (SELECT item_id, i, ascii(substr(qual, i, 1)) AS c FROM (SELECT item_id, qual, unnest(range(1, length(qual) + 1)) AS i FROM ({QUALS}) WHERE length(s) > 0))
SELECT CASE WHEN c < 59 THEN 'standard' ELSE 'illumina' END AS encoding FROM c WHERE c < 59 OR c > 74 ORDER BY item_id, i LIMIT 1""",
)
def quality_encoding_sniff(spark, sf):
    return fastq.encoding(_quals(spark, sf), ["item_id"])


SEEDS = f"WITH {V.CONTIGS_SQL}, seeds AS (SELECT contig_id, p AS pos, substr(seq, p + 1, 12) AS word FROM (SELECT contig_id, seq, unnest(range(0, greatest(length(seq) - 11, 0))) AS p FROM contigs))"


def _word(key, k=12):
    """The letters of a packed key."""
    return F.array_join(F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda i: F.substr(F.lit("ACGT"), (F.floor(key / F.pow(F.lit(4.0), i)) % 4 + 1).cast("int"), F.lit(1))), "")


@query("seed_histogram", SEEDS + " SELECT n, count(*) AS words FROM (SELECT word, count(*) AS n FROM seeds GROUP BY word) GROUP BY n")
def seed_histogram(spark, sf):
    return seeds.seed_counts(V.contigs(spark, sf), 12).groupBy("n").agg(F.count("*").alias("words"))


@query("seed_topk", SEEDS + " SELECT word, count(*) AS n FROM seeds GROUP BY word ORDER BY n DESC, word LIMIT 50")
def seed_topk(spark, sf):
    found = seeds.seed_counts(V.contigs(spark, sf), 12)
    return found.orderBy(F.desc("n"), "key").limit(50).select(_word(F.col("key")).alias("word"), "n")


@query("seed_prefix_offsets", SEEDS + ", g AS (SELECT substr(word, 1, 4) AS prefix, count(*) AS n FROM seeds GROUP BY 1) SELECT prefix, n, CAST(coalesce(sum(n) OVER (ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM g")
def seed_prefix_offsets(spark, sf):
    from pyspark.sql import Window

    counts = seeds.seed_counts(V.contigs(spark, sf), 12).groupBy(F.shiftright("key", 16).alias("p")).agg(F.sum("n").alias("n"))  # 256 prefixes
    first = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    word = _word(F.col("p"), 4)
    return counts.select(word.alias("prefix"), "n", first.alias("first"))


@query(
    "cpg_context_counts",
    f"""WITH {V.CONTIGS_SQL}, b AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM contigs),
x AS (SELECT substr(seq, i, 1) AS b, CASE WHEN i + 1 <= length(seq) THEN substr(seq, i + 1, 1) ELSE '' END AS n1, CASE WHEN i + 2 <= length(seq) THEN substr(seq, i + 2, 1) ELSE '' END AS n2, CASE WHEN i > 1 THEN substr(seq, i - 1, 1) ELSE '' END AS p1, CASE WHEN i > 2 THEN substr(seq, i - 2, 1) ELSE '' END AS p2 FROM b),
c AS (SELECT CASE WHEN b = 'C' THEN CASE WHEN n1 = 'G' THEN 'CG' WHEN n2 = 'G' THEN 'CHG' ELSE 'CHH' END ELSE CASE WHEN p1 = 'C' THEN 'CG' WHEN p2 = 'C' THEN 'CHG' ELSE 'CHH' END END AS context, CASE WHEN b = 'C' THEN '+' ELSE '-' END AS strand FROM x WHERE b IN ('C', 'G'))
SELECT context, strand, count(*) AS n FROM c GROUP BY ROLLUP (context, strand)""",
)
def cpg_context_counts(spark, sf):
    return methyl.context_counts(V.contigs(spark, sf))
