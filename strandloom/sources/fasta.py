"""FASTA: reading and writing; compressed files by their suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, paths: str | list[str], mask_lower: bool = False) -> DataFrame:
    """name, comment, seq of each record. Files split at record starts, so one large file is read by many tasks.

    The name ends at the first space or tab. Lower case becomes upper case, or N with mask_lower. The plan fails at a sequence with anything but letters."""
    raw = spark.read.option("lineSep", "\n>").text(paths)
    body = F.regexp_replace(F.regexp_replace(F.replace(F.col("value"), F.lit("\r"), F.lit("")), r"^\s*>", ""), r"\n+$", "")
    rows = raw.select(body.alias("value")).where(F.trim(F.col("value")) != "")
    head = F.substring_index("value", "\n", 1)
    lines = F.when(F.instr(F.col("value"), "\n") > 0, F.substr("value", F.length(head) + 2)).otherwise("")
    seq = F.regexp_replace(lines, r"\s", "")
    seq = F.upper(F.regexp_replace(seq, "[a-z]", "N") if mask_lower else seq)
    seq = F.when(seq.rlike("^[A-Z]*$"), seq).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), head)))
    return rows.select(F.regexp_extract(head, r"^([^ \t]*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^[^ \t]*[ \t]?(.*)$", 1)).alias("comment"), seq.alias("seq"))


def fasta_text(records: DataFrame, width: int = 60) -> DataFrame:
    """Records (name, comment, seq) as text, with lines of `width` bases in upper case."""
    head = F.concat(F.lit(">"), F.col("name"), F.when(F.coalesce(F.col("comment"), F.lit("")) != "", F.concat(F.lit(" "), F.col("comment"))).otherwise(""))
    lines = F.regexp_replace(F.regexp_replace(F.upper("seq"), f"(.{{{width}}})", "$1\n"), "\n$", "")
    return records.select(F.concat_ws("\n", head, lines).alias("value"))


def write_fasta(records: DataFrame, path: str, width: int = 60, compression: str | None = None) -> None:
    writer = fasta_text(records, width).write
    (writer.option("compression", compression) if compression else writer).text(path)
