"""Sequence-shaped views of the driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import contigs as C
from strandloom.plans.registry import table

READ = 60
#: A read's id is the passage's times this, and where it begins.
STEP = 1 << 20


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contigs() for queries that only search them: recoded where seeds are looked for."""
    return C.prose(table(spark, sf_dir, "documents"), "doc_id", "text")


def passages(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Whole benchmark passages in pieces of `size` bases, side by side, the last one back from the end; a shorter passage is one piece: read_id, seq."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), S.dna(F.col("text")).alias("s")).where(F.length("s") > 0)
    last = F.greatest(F.length("s") - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(size)), F.array(last)))
    cut = rows.select("item_id", "s", F.explode(starts).alias("at"))
    return cut.select((F.col("item_id") * STEP + F.col("at")).alias("read_id"), F.substr("s", F.col("at") + 1, F.lit(size)).alias("seq"))


def clean_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir, READ)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with up to three substitutions: base i (1-based) changes where (7 i + id) mod 23 is 0."""
    changed = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.when((i * 7 + F.col("read_id")) % 23 == 0, F.translate(F.substr("seq", i, F.lit(1)), "ACGT", "CGTA")).otherwise(F.substr("seq", i, F.lit(1)))), "")
    return clean_reads(spark, sf_dir).select("read_id", changed.alias("seq"))


def quality(seq, key):
    """Phred characters for a sequence: code 33 + (code of base i times (i + 3) + id) mod 42."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.char(F.lit(33) + (F.ascii(F.substr(seq, i, F.lit(1))) * (i + 3) + key) % 42)), "")


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns 2k and 2k + 1 of a conversation as the two reads of a pair."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), S.dna(F.col("text")).alias("seq"))
    a = turns.where("turn % 2 = 0").select("conv_id", F.expr("turn div 2").alias("k"), F.col("seq").alias("seq1"))
    b = turns.where("turn % 2 = 1").select("conv_id", F.expr("turn div 2").alias("k"), F.col("seq").alias("seq2"))
    return a.join(b, ["conv_id", "k"])


def dna_sql(x: str) -> str:
    return f"translate(regexp_replace(lower({x}),'[^a-z]','','g'),'{S.LETTERS}','{S.BASES_OF_LETTERS}')"


def revcomp_sql(x: str) -> str:
    return f"reverse(translate({x},'ACGT','TGCA'))"


CONTIGS_SQL = f"contigs AS (SELECT contig_id, seq FROM (SELECT doc_id AS contig_id, {dna_sql('text')} AS seq FROM documents) WHERE length(seq) > 0)"
def passages_sql(name: str, size: int) -> str:
    return f"{name} AS (SELECT item_id * {STEP} + start AS read_id, substr(s, CAST(start + 1 AS BIGINT), {size}) AS seq FROM (SELECT item_id, s, unnest(list_distinct(list_append(range(0, greatest(length(s) - {size}, 0) + 1, {size}), greatest(length(s) - {size}, 0)))) AS start FROM (SELECT item_id, {dna_sql('text')} AS s FROM benchmark) WHERE length(s) > 0))"


CLEAN_SQL = passages_sql("clean", READ)
READS_SQL = CLEAN_SQL + ", reads AS (SELECT read_id, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN (i * 7 + read_id) % 23 = 0 THEN translate(substr(seq, i, 1), 'ACGT', 'CGTA') ELSE substr(seq, i, 1) END), '') AS seq FROM clean)"


def strands_sql(reads_: str, name: str = "patterns") -> str:
    return f"{name} AS (SELECT read_id, '+' AS strand, seq AS pattern FROM {reads_} UNION ALL SELECT read_id, '-', {revcomp_sql('seq')} FROM {reads_})"


def pairs_sql(name: str, patterns: str, contigs_: str, errors: int, pattern: str = "pattern", seq: str = "seq") -> str:
    """Places (read_id, strand, contig_id, pos) where one of errors + 1 pieces of a pattern is the same: all places with at most so many differences are among them."""
    return (
        f"{name}_p AS (SELECT *, i * k AS off, substr({pattern}, CAST(i * k + 1 AS BIGINT), CAST(k AS BIGINT)) AS key FROM (SELECT *, length({pattern}) // {errors + 1} AS k, unnest(range(0, {errors + 1})) AS i FROM {patterns})), "
        f"{name}_w AS (SELECT contig_id, k, p, substr({seq}, CAST(p + 1 AS BIGINT), CAST(k AS BIGINT)) AS key FROM (SELECT contig_id, {seq}, k, unnest(range(0, greatest(length({seq}) - k + 1, 0))) AS p FROM {contigs_}, (SELECT DISTINCT k FROM {name}_p))), "
        f"{name} AS MATERIALIZED (SELECT DISTINCT read_id, strand, contig_id, p - off AS pos FROM {name}_p JOIN {name}_w USING (k, key) WHERE p >= off)"
    )


def hits_sql(errors: int, reads_: str = "reads") -> str:
    """All hits with at most so many differences as a list of common table expressions that ends in hits."""
    first = READS_SQL if reads_ == "reads" else CLEAN_SQL
    found = "hits AS (SELECT * FROM (SELECT read_id, contig_id, pos, strand, hamming(substr(seq, CAST(pos + 1 AS BIGINT), length(pattern)), pattern) AS nm FROM cand JOIN patterns USING (read_id, strand) JOIN contigs USING (contig_id) WHERE pos + length(pattern) <= length(seq)) WHERE nm <= " + str(errors) + ")"
    return f"WITH {CONTIGS_SQL}, {first}, {strands_sql(reads_)}, {pairs_sql('cand', 'patterns', 'contigs', errors)}, {found}"


MATES_SQL = f"turns AS (SELECT conv_id, turn, {dna_sql('text')} AS seq FROM conversations), mates AS (SELECT a.conv_id, a.turn // 2 AS k, a.seq AS seq1, b.seq AS seq2 FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)"
