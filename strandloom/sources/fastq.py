"""FASTQ: a data source with one reader for each file, an encoding sniff, and a writer.

A record can't be told from the middle of a file (a quality line may begin with @), so for `read_fastq` a file is one partition; many files are many.
`read_split` reads uncompressed files of four-line records in as many tasks as they have splits: text is cut before each @ that begins a line, pieces are put together again within a split, and what a cut has parted between two splits meets by a join.
Files are read through Spark's own file source as bytes, so any store Spark reads is fine, and .gz and .bz2 are unpacked by suffix.
"""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S

SCHEMA = "file string, ordinal long, id string, comment string, seq string, qual string"


def records(stream: io.TextIOBase) -> Iterator[tuple[str, str, str, str]]:
    """id, comment, seq and qual; sequences and qualities may run over several lines. Raises ValueError where the format is broken."""
    line = stream.readline()
    while line:
        line = line.rstrip("\r\n")
        if not line.strip():
            line = stream.readline()
            continue
        if line[0] != "@":
            raise ValueError(f"a record begins with {line[:20]!r}")
        name, _, comment = line[1:].replace("\t", " ", 1).partition(" ")
        seq: list[str] = []
        line = stream.readline()
        while line and not line.startswith("+"):
            seq.append(line.strip())
            line = stream.readline()
        bases, qual, size = "".join(seq), [], 0
        if not line:
            raise ValueError(f"no quality for {name}")
        while size < len(bases):
            line = stream.readline()
            if not line:
                break
            qual.append(line.rstrip("\r\n"))
            size += len(qual[-1])
        if size != len(bases):
            raise ValueError(f"{name} has {len(bases)} bases and {size} qualities")
        yield name, comment, bases.upper(), "".join(qual)
        line = stream.readline()


def _opened(path: str, content: bytes) -> io.TextIOBase:
    raw = io.BytesIO(content)
    unpacked = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else bz2.BZ2File(raw) if path.endswith(".bz2") else raw
    return io.TextIOWrapper(unpacked, "utf-8", newline="\n")


def read_fastq(spark: SparkSession, paths: str | list[str], illumina: bool = False, longest: int | None = None) -> DataFrame:
    """file, ordinal (0.. in the file), id, comment, seq, qual (offset 33; with `illumina` moved down by 31). `longest` makes the plan fail at longer reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for i, record in enumerate(records(_opened(path, content))):
                    rows.append((path, i, *record))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "ordinal", "id", "comment", "seq", "qual"])

    found = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, SCHEMA)
    if illumina:
        found = found.withColumn("qual", S.shift_quality(F.col("qual"), -31))
    if longest is not None:
        found = found.where(F.when(F.length("seq") <= longest, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("read too long: "), F.col("id"))).cast("boolean")))
    return found


_PIECES = "file string, block long, idx long, lines array<string>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks between two cuts to records of four lines, and to the two halves (three lines, one line) of a record whose other half is in another split."""
    own, held, idx = None, None, 0
    for batch in batches:
        out: list[tuple] = []
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
            if own != (file, block):
                if held:
                    out.append((*own, idx, held))
                own, held, idx = (file, block), None, 0
            lines = [x.removesuffix("\r") for x in value.split("\n")]
            if not block and not idx and not held and lines[0].startswith("@"):
                lines[0] = lines[0][1:]
            if len(lines) in (2, 5) and not lines[-1]:  # the end of a file
                lines.pop()
            if held:
                lines, held = held + ["@" + lines[0], *lines[1:]], None
            elif len(lines) == 1 and not idx and block:
                out.append((file, block, -1, lines))
                continue
            if len(lines) == 3:
                held = lines
                continue
            if lines == [""]:
                continue
            out.append((file, block, idx, lines))
            idx += 1
        yield _pieces_batch(out)
    if held:
        yield _pieces_batch([(*own, idx, held)])


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))], ["file", "block", "idx", "lines"])


def read_split(spark: SparkSession, paths: str | list[str], illumina: bool = False) -> DataFrame:
    """The columns of read_fastq, from plain files whose records have four lines each; the plan fails at others."""
    raw = spark.read.option("lineSep", "\n@").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = raw.mapInArrow(_chunks, _PIECES)
    whole = pieces.where((F.size("lines") != 1) & (F.size("lines") != 3))
    # At most two halves for each split.
    own = Window.partitionBy("file").orderBy("block", "idx")
    halves = pieces.where((F.size("lines") == 1) | (F.size("lines") == 3)).withColumns({"next": F.lead("lines").over(own), "first": F.lag(F.size("lines")).over(own).isNull()}).where((F.size("lines") == 3) | F.col("first"))
    joined = halves.select("file", "block", "idx", F.concat("lines", F.transform(F.coalesce("next", F.array().cast("array<string>")), lambda x: F.concat(F.lit("@"), x))).alias("lines"))
    rows = whole.unionByName(joined)
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each split
    line = lambda i: F.get("lines", i)
    right = (F.size("lines") == 4) & line(2).startswith("+") & (F.length(line(1)) == F.length(line(3)))
    checked = rows.join(before, ["file", "block"]).where(F.when(right, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a record of four lines: "), line(0))).cast("boolean")))
    head = F.regexp_extract(line(0), r"^([^ \t]*)[ \t]?(.*)$", 1), F.regexp_extract(line(0), r"^([^ \t]*)[ \t]?(.*)$", 2)
    qual = S.shift_quality(line(3), -31) if illumina else line(3)
    return checked.select("file", (F.col("before") + F.col("idx")).alias("ordinal"), head[0].alias("id"), head[1].alias("comment"), F.upper(line(1)).alias("seq"), qual.alias("qual"))


def encoding(reads: DataFrame, order: list[str], qual: str = "qual") -> DataFrame:
    """One row: standard, illumina or unknown, by the first quality character below 59 or above 74."""
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c))
    first = F.get(F.filter(codes, lambda c: (c < 59) | (c > 74)), 0)
    decided = reads.where(F.length(qual) > 0).select(F.struct(*order).alias("o"), first.alias("c")).where("c is not null")
    least = decided.agg(F.min_by("c", "o").alias("c"))
    return least.select(F.when(F.col("c") < 59, "standard").when(F.col("c") > 74, "illumina").otherwise("unknown").alias("encoding"))


def fastq_text(reads: DataFrame, illumina: bool = False, keep: list[str] | None = None, upper: bool = True) -> DataFrame:
    """Records as text, and the columns that are kept beside it."""
    qual = S.shift_quality(F.col("qual"), 31) if illumina else F.col("qual")
    head = F.concat(F.lit("@"), F.col("id"), F.when(F.coalesce(F.col("comment"), F.lit("")) != "", F.concat(F.lit(" "), F.col("comment"))).otherwise(""))
    return reads.select(*(keep or []), F.concat_ws("\n", head, F.upper("seq") if upper else F.col("seq"), F.lit("+"), qual).alias("value"))


def write_fastq(reads: DataFrame, path: str, illumina: bool = False, compression: str | None = None) -> None:
    writer = fastq_text(reads, illumina).write
    (writer.option("compression", compression) if compression else writer).text(path)


def write_routed(reads: DataFrame, path: str) -> None:
    """Reads with a route as text files in a folder for each route."""
    text = fastq_text(reads.select("id", "comment", "seq", "qual", "route") if "comment" in reads.columns else reads.withColumn("comment", F.lit(None).cast("string")), keep=["route"])
    text.where("route is not null").write.partitionBy("route").text(path)


def record_of(reads: DataFrame, form: str = "trimmed") -> DataFrame:
    """Trimmed reads (id, seq, qual, good_start, good_stop, discarded) as records to write: "trimmed" (only the good part), "masked" (all, what is outside it in lower case), or "original"."""
    from strandloom.operators.trim import trimmed

    if form == "trimmed":
        return trimmed(reads)
    if form == "masked":
        return reads.withColumn("seq", S.masked(F.col("seq"), F.col("good_start"), F.col("good_stop"), F.col("discarded")))
    if form == "original":
        return reads
    raise ValueError("a record is trimmed, masked or original")


def forms(spark: SparkSession, path: str) -> DataFrame:
    """The form of each file, by the first character of its first split that is @ (fastq) or > (fasta): file, form. Files without one are left out."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_extract("value", "^[^>@]*([>@])", 1).alias("first"))
    firsts = text.where("block = 0 and first <> ''").withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("first", "at").alias("first"))
    return firsts.select("file", F.when(F.col("first") == "@", "fastq").otherwise("fasta").alias("form"))


def read_records(spark: SparkSession, path: str, illumina: bool = False) -> DataFrame:
    """FASTA or FASTQ, each file by the first of its characters that is @ or >, whatever its name is: name, comment, seq, qual (null in FASTA). The driver has a row for each file."""
    from strandloom.sources.fasta import read_fasta

    files: dict[str, list[str]] = {"fastq": [], "fasta": []}
    for r in forms(spark, path).collect():
        files[r.form].append(unquote(r.file))
    found = spark.createDataFrame([], "name string, comment string, seq string, qual string")
    if files["fastq"]:
        found = found.unionByName(read_fastq(spark, files["fastq"], illumina).select(F.col("id").alias("name"), "comment", "seq", "qual"))
    if files["fasta"]:
        found = found.unionByName(read_fasta(spark, files["fasta"]).withColumn("qual", F.lit(None).cast("string")))
    return found
