"""Column functions over sequences and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The complement of each IUPAC base letter; others stay.
IUPAC = "ACGTURYMKSWBVDHN"
IUPAC_COMPLEMENT = "TGCAAYRKMSWVBHDN"
# What stands for each letter when prose is recoded to bases.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES_OF_LETTERS = "ACGTACGTACGTACGTACGTACGTAC"


def dna(text: Column) -> Column:
    """Prose as a sequence over ACGT: letters a-z only, by position in the alphabet modulo 4."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES_OF_LETTERS)


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower())


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def revcomp_strict(seq: Column) -> Column:
    """Reverse complement in which all but A, C, G and T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def lower_n(seq: Column) -> Column:
    return F.replace(seq, F.lit("N"), F.lit("n"))


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def good_part(seq: Column, start: Column, stop: Column, discarded: Column) -> Column:
    """Bases start..stop (1-based, inclusive); nothing if discarded, all of it without a region."""
    return F.when(discarded, "").when(start.isNull() | (start < 1), seq).otherwise(F.substring(seq, start, stop - start + 1))


def masked(seq: Column, start: Column, stop: Column, discarded: Column) -> Column:
    """The sequence with everything outside start..stop in lower case; all of it if discarded."""
    inside = F.concat(F.lower(F.substring(seq, F.lit(1), start - 1)), F.substring(seq, start, stop - start + 1), F.lower(F.substring(seq, stop + 1, F.length(seq))))
    return F.when(discarded, F.lower(seq)).when(start.isNull() | (start < 1), seq).otherwise(inside)


def phred(qual: Column, offset: int = 33) -> Column:
    """Quality characters as numbers."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset)


def phred_text(quality: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(quality, lambda q: F.char(q + offset)), "")


def shift_quality(qual: Column, by: int) -> Column:
    """Each quality character moved by a number of codes, as between the two common offsets (31)."""
    return F.array_join(F.transform(F.split(qual, ""), lambda c: F.char(F.ascii(c) + by)), "")


def error_budget(length: Column, rate: int = 15) -> Column:
    """One error for every `rate` bases, rounded half away from zero."""
    return F.round(length / F.lit(rate)).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two sequences of one length differ; null if their lengths do."""
    differ = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: n + F.when(F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)), 1).otherwise(0))
    return F.when(F.length(a) != F.length(b), None).when(F.length(a) == 0, 0).otherwise(differ)


def bisulfite_distance(read: Column, reference: Column, strand: Column) -> Column:
    """Differences, where on + a T read over C is none, and on - an A (of the reverse-complemented read) over G."""
    free = F.when(strand == "+", F.lit("CT")).otherwise(F.lit("GA"))
    step = lambda n, i: n + F.when(F.substr(read, i, F.lit(1)) == F.substr(reference, i, F.lit(1)), 0).when(F.concat(F.substr(reference, i, F.lit(1)), F.substr(read, i, F.lit(1))) == free, 0).otherwise(1)
    return F.when(F.length(read) != F.length(reference), None).when(F.length(read) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(read)), F.lit(0), step))


def cytosine_context(seq: Column, pos: Column) -> Column:
    """CG, CHG or CHH of the C at pos (0-based), or of the G there read on the other strand; beyond the ends is H. Null at other bases."""
    at = lambda p: F.when(p >= 0, F.substring(seq, p + 1, F.lit(1))).otherwise("")
    forward = F.when(at(pos + 1) == "G", "CG").when(at(pos + 2) == "G", "CHG").otherwise("CHH")
    backward = F.when(at(pos - 1) == "C", "CG").when(at(pos - 2) == "C", "CHG").otherwise("CHH")
    return F.when(at(pos) == "C", forward).when(at(pos) == "G", backward)


def index_width(size: Column, bisulfite: bool = False) -> Column:
    """Seed width from a reference's size: its logarithm to base 4 within 10..15, or to base 2 within 20..30."""
    low, high, base = (20, 30, 2.0) if bisulfite else (10, 15, 4.0)
    return F.least(F.greatest(F.ceil(F.round(F.log(base, size), 9)), F.lit(low)), F.lit(high)).cast("int")


def description(name: Column, seq: Column, first: int = 20) -> Column:
    return F.concat(name, F.lit(": "), F.substring(seq, F.lit(1), F.lit(first)), F.lit(" ("), F.length(seq), F.lit(")"))


def debug_text(name: Column, seq: Column, qual: Column, start: Column, stop: Column, discarded: Column) -> Column:
    """All that is known of a read, in a line."""
    region = F.when(discarded, "discarded").otherwise(F.concat_ws("-", start.cast("string"), stop.cast("string")))
    return F.concat(name, F.lit(" ["), F.length(seq), F.lit("] "), region, F.lit(" "), masked(seq, start, stop, discarded), F.lit(" "), qual)


# The two-base codes of a colour for each pair of bases, in the order A, C, G, T.
COLOURS = {"AA": "0", "CC": "0", "GG": "0", "TT": "0", "AC": "1", "CA": "1", "GT": "1", "TG": "1", "AG": "2", "GA": "2", "CT": "2", "TC": "2", "AT": "3", "TA": "3", "CG": "3", "GC": "3"}


def colours(seq: Column) -> Column:
    """A sequence in colour space: its first base, then a digit for each step to the next; a step to or from another letter is "$", which also stands for a missing colour (".")."""
    table = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    steps = F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.coalesce(F.try_element_at(table, F.substr(seq, i, F.lit(2))), F.lit("$")))
    return F.when(F.length(seq) < 2, seq).otherwise(F.concat(F.left(seq, F.lit(1)), F.array_join(steps, "")))


def bases_of_colours(read: Column) -> Column:
    """The other way: a base and colours to bases, N from the first missing colour on ("." or "$")."""
    table = F.create_map(*(F.lit(x) for (a, b), c in COLOURS.items() for x in (a + c, b)))
    step = lambda s, c: F.struct(F.coalesce(F.try_element_at(table, F.concat(s["last"], c)), F.lit("N")).alias("last"), s["out"].alias("out"))
    grown = lambda s, c: F.transform(F.array(step(s, c)), lambda x: F.struct(x["last"].alias("last"), F.concat(x["out"], x["last"]).alias("out")))[0]
    start = F.struct(F.left(read, F.lit(1)).alias("last"), F.left(read, F.lit(1)).alias("out"))
    return F.aggregate(F.filter(F.split(F.substr(read, F.lit(2)), ""), lambda c: c != ""), start, grown, lambda s: s["out"])


def missing_colours(read: Column) -> Column:
    return F.translate(read, ".", "$")
