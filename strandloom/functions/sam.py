"""Column functions for the fields of alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the flag field and their letters.
BITS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024}
LETTERS = "pPuUrR12sfd"
#: Records that a pileup leaves out: unmapped, secondary, failed, duplicate.
PILEUP_MASK = 4 | 256 | 512 | 1024


def flag(**bits: Column) -> Column:
    """The flag of a record from boolean columns by name; null counts as false."""
    found = F.lit(0)
    for name, value in bits.items():
        found = found + F.when(value, BITS[name]).otherwise(0)
    return found.cast("int")


def has(flag_: Column, name: str) -> Column:
    return flag_.bitwiseAND(BITS[name]) != 0


def flag_letters(flag_: Column) -> Column:
    return F.concat(*(F.when(flag_.bitwiseAND(1 << i) != 0, c).otherwise("") for i, c in enumerate(LETTERS)))


def mapq(hits: Column) -> Column:
    """60 for exactly one hit, else 0."""
    return F.when(hits == 1, 60).otherwise(0)


def five_prime(pos: Column, span: Column, strand: Column) -> Column:
    """1-based coordinate of the first base read."""
    return F.when(strand == "+", pos).otherwise(pos + span - 1)


def tlen(contig: Column, five: Column, mate_contig: Column, mate_five: Column) -> Column:
    return F.when(contig == mate_contig, mate_five - five).otherwise(0).cast("long")


def proper_pair(contig1: Column, pos1: Column, end1: Column, strand1: Column, contig2: Column, pos2: Column, end2: Column, strand2: Column, insert_min: int | None = None, insert_max: int | None = None) -> Column:
    """Mates on one contig that face each other, with an insert size within the limits."""
    facing = F.when((strand1 == "+") & (strand2 == "-"), pos1 <= end2).when((strand1 == "-") & (strand2 == "+"), pos2 <= end1).otherwise(False)
    found = (contig1 == contig2) & facing
    size = F.greatest(end1, end2) - F.least(pos1, pos2) + 1
    if insert_max is not None:
        found = found & size.between(insert_min or 0, insert_max)
    return F.coalesce(found, F.lit(False))


def pair_name(name: Column) -> Column:
    """A read name without the mark of its place in the pair."""
    return F.regexp_replace(name, "/?[12]$", "")


def common_name(first: Column, second: Column) -> Column:
    """What two mates' names begin with, without a slash at its end."""
    sizes = F.sequence(F.lit(0), F.least(F.length(first), F.length(second)))
    shared = F.array_max(F.filter(sizes, lambda n: F.left(first, n) == F.left(second, n)))
    return F.regexp_replace(F.left(first, shared), "/$", "")


def flag_text(flag_: Column, form: str = "decimal") -> Column:
    """A flag as a decimal number, as hexadecimal digits after 0x, or as letters."""
    if form not in ("decimal", "hex", "letters"):
        raise ValueError("a flag is written as decimal, hex or letters")
    return flag_.cast("string") if form == "decimal" else F.concat(F.lit("0x"), F.lower(F.hex(flag_))) if form == "hex" else flag_letters(flag_)


def strand_char(reverse: Column) -> Column:
    return F.when(reverse.isNull(), ".").when(reverse, "-").otherwise("+")


def status(hits: Column, low_quality: Column, contaminated: Column) -> Column:
    """Q low quality, C contaminated, N not found, A aligned once, E several times."""
    return F.when(low_quality, "Q").when(contaminated, "C").when(F.coalesce(hits, F.lit(0)) == 0, "N").when(hits == 1, "A").otherwise("E")


def alignment_class(flag_: Column, nh: Column, contaminated: Column) -> Column:
    return F.when(contaminated, "contamination").when(has(flag_, "qc_fail"), "quality_discarded").when(has(flag_, "unmapped"), "not_found").when(F.coalesce(nh, F.lit(1)) == 1, "unique").otherwise("multiple")


def tags(**values: Column) -> Column:
    """TAG:type:value fields with a tab between; null values are left out."""
    kind = {"string": "Z", "int": "i"}
    return F.concat_ws("\t", *(F.when(v.isNotNull(), F.concat(F.lit(f"{name.split('_')[0]}:{kind[name.split('_')[1]]}:"), v.cast("string"))) for name, v in values.items()))


def tag_map(text: Column) -> Column:
    """Fields of TAG:type:value as a map of tag to value."""
    fields = F.filter(F.split(text, "\t"), lambda f: F.length(f) > 5)
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(F.substring(f, 1, 2), F.substr(f, F.lit(6)))))


TAGS = "map<string, struct<code: string, value: string>>"


def typed_tags(text: Column) -> Column:
    """Fields of TAG:type:value as a map of tag to (code, value)."""
    fields = F.filter(F.split(text, "\t"), lambda f: F.length(f) >= 5)
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(F.substring(f, 1, 2), F.struct(F.substring(f, 4, 1).alias("code"), F.substr(f, F.lit(6)).alias("value")))))


def error_histogram(pairs: Column) -> Column:
    """Array of (nm, n) as "nm:n" joined by semicolons, in order of nm."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat_ws(":", p["nm"].cast("string"), p["n"].cast("string"))), ";")


def record(*columns: Column) -> Column:
    """The fields of a record as a line; null fields become what the format writes for them."""
    return F.concat_ws("\t", *columns)


def region(text: Column) -> Column:
    """"name:begin-end" (1-based, commas allowed) as (name, begin 0-based, end); without an end to 2**29."""
    clean = F.replace(text, F.lit(","), F.lit(""))
    name, begin, end = (F.regexp_extract(clean, r"^(.*?)(?::([0-9]+)(?:-([0-9]+))?)?$", i) for i in (1, 2, 3))
    return F.struct(name.alias("name"), F.greatest(F.coalesce(F.when(begin != "", begin.cast("long") - 1), F.lit(0)), F.lit(0)).cast("long").alias("begin"), F.when(end != "", end.cast("long")).otherwise(1 << 29).cast("long").alias("end"))
