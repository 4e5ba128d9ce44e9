"""SAM text and BAM: headers, records, reading and writing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, StringType

from strandloom.functions import cigar as G
from strandloom.functions import sam as M
from strandloom.functions import seq as S
from strandloom.sources.bam import COLUMNS, KINDS, bam_bytes, packed_bases, read_bam, unpacked_bases, write_bam  # noqa: F401


def kind(name: str) -> str:
    """bam, sam or stdin by a file's name; compressed text isn't supported."""
    if name == "-":
        return "stdin"
    if name.endswith(".bam"):
        return "bam"
    if name.endswith((".sam", ".tam")):
        return "sam"
    if name.endswith((".sam.gz", ".sam.bz2")):
        raise ValueError("compressed SAM text isn't supported")
    raise ValueError(f"{name} is neither SAM nor BAM by its name")


def records_of(lines: DataFrame) -> DataFrame:
    """Text lines (value) to records of eleven columns and tags; header lines are left out."""
    parts = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    fields = [F.col("f")[i].cast(k).alias(c) for i, (c, k) in enumerate(zip(COLUMNS, KINDS))]
    return parts.select(*fields, M.typed_tags(F.array_join(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), "\t")).alias("tags"))


def header_of(lines: DataFrame) -> DataFrame:
    """Header lines to rec_type and attrs."""
    body = F.substr("value", F.lit(5))
    attrs = F.when(F.col("value").startswith("@CO"), F.create_map(F.lit("text"), body)).otherwise(F.str_to_map(body, F.lit("\t"), F.lit(":")))
    return lines.where(F.col("value").startswith("@")).select(F.substring("value", 2, 2).alias("rec_type"), attrs.alias("attrs"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return records_of(spark.read.option("recursiveFileLookup", "true").text(path))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return header_of(spark.read.option("recursiveFileLookup", "true").text(path))


def targets(header: DataFrame) -> DataFrame:
    """Contigs that a header names: name and length."""
    return header.where("rec_type = 'SQ'").select(F.col("attrs")["SN"].alias("name"), F.col("attrs")["LN"].cast("long").alias("length"))


def targets_of_table(spark: SparkSession, path: str) -> DataFrame:
    """name and length from a table with a tab between; the plan fails at a name that occurs twice."""
    from strandloom.operators.contigs import unique_names

    return unique_names(spark.read.csv(path, sep="\t", schema="name string, length long"))


def header_text(spark: SparkSession, contigs: list[tuple[str, int]], program: str, group: str | None = None, sample: str = "no_sample_specified", comments: tuple[str, ...] = ()) -> DataFrame:
    """Header lines in order: ordinal and value."""
    lines = ["@HD\tVN:1.0\tSO:unsorted", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs), *([f"@RG\tID:{group}\tSM:{sample}"] if group else []), f"@PG\tID:{program}", *(f"@CO\t{c}" for c in comments)]
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ordinal int, value string")


def merged(headers: DataFrame) -> DataFrame:
    """Header rows of several files as one; the plan fails where one key (SN, ID) has different attributes."""
    key = F.coalesce(F.col("attrs")["SN"], F.col("attrs")["ID"], F.to_json("attrs"))
    groups = headers.groupBy("rec_type", key.alias("key")).agg(F.collect_set(F.to_json("attrs")).alias("forms"), F.first("attrs").alias("attrs"))
    return groups.where(F.when((F.size("forms") > 1) & F.col("rec_type").isin("SQ", "RG"), F.raise_error(F.concat(F.lit("headers differ at "), F.col("key")))).otherwise(True)).select("rec_type", "attrs")


def is_sorted(header: DataFrame) -> bool:
    return header.where("rec_type = 'HD' and attrs['SO'] = 'coordinate'").limit(1).count() > 0


def unsorted(lines: DataFrame) -> DataFrame:
    return lines.withColumn("value", F.regexp_replace("value", r"(^@HD.*)SO:coordinate", "$1SO:unsorted"))


def text_of(records: DataFrame, flags: str = "decimal") -> DataFrame:
    """Records as lines; null fields are written as the format has it, typed tags in their order, plain ones in order of their names. `flags`: decimal, hex or letters."""
    c = F.col
    default = {"rname": "*", "pos": "0", "mapq": "0", "cigar": "*", "rnext": "*", "pnext": "0", "tlen": "0", "seq": "*", "qual": "*", "flag": "0"}
    fields = [F.when(c(x).isNull() | (c(x).cast("string") == ""), default.get(x, "*")).otherwise(c(x).cast("string")) for x in COLUMNS]
    fields[1] = M.flag_text(F.coalesce(c("flag"), F.lit(0)), flags)
    out = F.concat_ws("\t", *fields)
    if "tags" in records.columns:
        if isinstance(records.schema["tags"].dataType.valueType, StringType):  # plain values: whole numbers, as numbers are written, are i, all else is Z
            entries = F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>"))))
            field = lambda e: F.concat(e["key"], F.when(e["value"].rlike("^(0|-?[1-9][0-9]{0,8})$"), F.lit(":i:")).otherwise(F.lit(":Z:")), e["value"])
        else:
            entries = F.coalesce(F.map_entries("tags"), F.array())
            field = lambda e: F.concat(e["key"], F.lit(":"), F.when(e["value"]["code"].isin(*"cCsSI"), F.lit("i")).otherwise(e["value"]["code"]), F.lit(":"), e["value"]["value"])
        text = F.array_join(F.transform(entries, field), "\t")
        out = F.when(F.length(text) > 0, F.concat_ws("\t", out, text)).otherwise(out)
    return records.select(out.alias("value"))


def write_sam(records: DataFrame, header: DataFrame | None, path: str, flags: str = "decimal") -> None:
    """SAM text as folders: 0_header with one file (none without a header), 1_records with one for each partition. The files in order of their paths are one SAM text; read_sam and read_header read the folder."""
    if header is not None:
        header.orderBy("ordinal").select("value").coalesce(1).write.text(f"{path}/0_header")
    text_of(records, flags).write.text(f"{path}/1_records")


def write(records: DataFrame, header: DataFrame, contigs: list[tuple[str, int]], path: str, mode: str = "w") -> None:
    """By mode, letters after w: nothing is text without a header, h with one, b BAM, u BAM uncompressed, x flags in hexadecimal, X flags as letters."""
    if not re.fullmatch("w[bhuxX]*", mode):
        raise ValueError(f"{mode} isn't a mode to write with")
    if "b" in mode or "u" in mode:
        lines = "".join(f"{r.value}\n" for r in header.orderBy("ordinal").collect())  # a header
        write_bam(records, contigs, path, lines, 0 if "u" in mode else 6)
    else:
        write_sam(records, header if "h" in mode else None, path, "hex" if "x" in mode else "letters" if "X" in mode else "decimal")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text or BAM, by the file's name (kind)."""
    return read_bam(spark, path) if kind(path) == "bam" else read_sam(spark, path)


def reversed_records(records: DataFrame) -> DataFrame:
    """Each record read in the other direction: bases complemented, qualities and CIGAR turned round, and the bit of the strand changed."""
    none = lambda c, value: F.when(F.col(c).isNull() | (F.col(c) == "*"), F.col(c)).otherwise(value)
    return records.withColumns({"seq": none("seq", S.revcomp(F.col("seq"))), "qual": none("qual", F.reverse("qual")), "cigar": none("cigar", G.reversed_text(F.col("cigar"))), "flag": F.col("flag").bitwiseXOR(M.BITS["reverse"])})


def renamed(lines: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Header lines in which a pattern is replaced."""
    return lines.withColumn("value", F.when(F.col("value").startswith("@"), F.regexp_replace("value", pattern, replacement)).otherwise(F.col("value")))


# Attributes that a header line of a type must have.
_NEEDED = {"HD": ["VN"], "SQ": ["SN", "LN"], "RG": ["ID"], "PG": ["ID"], "CO": []}


def problems(header: DataFrame) -> DataFrame:
    """Header rows that are not valid (rec_type, attrs), with what is wrong: unknown types, attributes that are missing."""
    needed = F.create_map(*(x for k, v in _NEEDED.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    wanted = F.try_element_at(needed, F.col("rec_type"))
    lacks = F.filter(wanted, lambda a: ~F.map_contains_key("attrs", a))
    problem = F.when(wanted.isNull(), "unknown type").when(F.size(lacks) > 0, F.concat(F.lit("without "), F.array_join(lacks, ", ")))
    return header.withColumn("problem", problem).where("problem is not null")


def header_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Header rows that only one of two headers has, with only_in 1 or 2."""
    flat = lambda h: h.select("rec_type", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs")))).alias("attrs"))
    return flat(a).exceptAll(flat(b)).withColumn("only_in", F.lit(1)).unionByName(flat(b).exceptAll(flat(a)).withColumn("only_in", F.lit(2)))


def with_library(records: DataFrame, header: DataFrame) -> DataFrame:
    """Adds library: the LB of the read group that a record's RG tag names."""
    groups = header.where("rec_type = 'RG'").select(F.col("attrs")["ID"].alias("_rg"), F.col("attrs")["LB"].alias("library"))
    return records.withColumn("_rg", F.col("tags")["RG"]["value"]).join(groups, "_rg", "left").drop("_rg")


def with_tag(records: DataFrame, tag: str, value, code: str | None = None) -> DataFrame:
    """Records with a tag set to a column's value; its code, where none is given, is i, f or Z by the column's type."""
    kind = records.select(value).schema[0].dataType
    code = code or ("i" if isinstance(kind, IntegralType) else "f" if isinstance(kind, FractionalType) else "Z")
    empty = F.create_map().cast(M.TAGS)
    others = F.map_filter(F.coalesce("tags", empty), lambda k, v: k != tag)
    return records.withColumn("tags", F.map_concat(others, F.create_map(F.lit(tag), F.struct(F.lit(code).alias("code"), value.cast("string").alias("value")))))


def retargeted(header: DataFrame, contigs: DataFrame) -> DataFrame:
    """A header whose contig lines are replaced by contigs (name, length)."""
    lines = contigs.select(F.lit("SQ").alias("rec_type"), F.create_map(F.lit("SN"), F.col("name"), F.lit("LN"), F.col("length").cast("string")).alias("attrs"))
    return header.where("rec_type <> 'SQ'").unionByName(lines)


def in_region(records: DataFrame, name: str, begin: int, end: int) -> DataFrame:
    """Records that overlap [begin, end) (0-based) of a contig."""
    from strandloom.functions import cigar as C

    span = F.greatest(C.reference_span(C.operations(F.col("cigar"))), F.lit(1))
    return records.where((F.col("rname") == name) & (F.col("pos") - 1 < end) & (F.col("pos") - 1 + span > begin))


def write_sorted(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Records in order of contig and position over range partitions, in columns: row groups serve as the index that a region's reader prunes by."""
    dealt = records.repartitionByRange(partitions, "rname", "pos") if partitions else records.repartitionByRange("rname", "pos")
    dealt.sortWithinPartitions("rname", "pos").write.parquet(path)
