"""Column functions over CIGAR strings, held as text or as array<struct<len int, op string>>."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """"3S10M2D" as an array of (len, op); "*" and null have none."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "[0-9]+", 0).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def text(ops: Column) -> Column:
    return F.when(F.size(ops) == 0, "*").otherwise(F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), ""))


def total(ops: Column, kinds: str) -> Column:
    """Length of all operations of these kinds."""
    return F.aggregate(ops, F.lit(0), lambda n, o: n + F.when(F.instr(F.lit(kinds), o["op"]) > 0, o["len"]).otherwise(0))


def reference_span(ops: Column) -> Column:
    return total(ops, "MDN=X")


def query_length(ops: Column) -> Column:
    return total(ops, "MIS=X")


def left_clip(ops: Column) -> Column:
    """Soft-clipped bases at the beginning, behind a hard clip if there is one."""
    soft = F.filter(F.slice(ops, 1, 2), lambda o, i: (o["op"] == "S") & ((i == 0) | (ops[0]["op"] == "H")))
    return F.coalesce(F.get(soft, 0)["len"], F.lit(0))


def right_clip(ops: Column) -> Column:
    return F.when(F.size(ops) > 1, left_clip(F.reverse(ops))).otherwise(0)


def neighbourhood(ops: Column) -> Column:
    """Operations with what lies around each match between clips and skipped stretches: indel, the length of the insertion (negative: deletion) between it and the next match, padding aside, and whether it is the first and the last match there."""
    letters = F.translate(F.array_join(F.transform(ops, lambda o: o["op"]), ""), "=X", "MM")

    def around(o: Column, i: Column) -> Column:
        after = F.substr(letters, i + 2)
        other = F.get(ops, i + F.when(after.startswith("P"), 2).otherwise(1))
        more, match = after.rlike("^[^MNSH]*M"), o["op"].isin("M", "=", "X")
        size = F.when(other["op"] == "I", other["len"]).when(other["op"] == "D", -other["len"])
        first = ~F.substr(letters, F.lit(1), i).rlike("M[^NSH]*$")
        return F.struct(o["len"].alias("len"), o["op"].alias("op"), F.coalesce(F.when(match & more, size), F.lit(0)).alias("indel"), (match & first).alias("first"), (match & ~more).alias("last"))

    return F.transform(ops, around)


def _around(cigar: str) -> list[tuple[int, int, int, str, int, bool, bool]]:
    """blocks(neighbourhood(operations)) of one text at position 0, in time that grows with its length."""
    ops = [(int(n), o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]
    more, ahead = [], False
    for _, o in reversed(ops):
        more.append(ahead)
        ahead = o in "M=X" or (ahead and o not in "NSH")
    more.reverse()
    out, ref, query, seen = [], 0, 0, False
    for i, (n, o) in enumerate(ops):
        match = o in "M=X"
        if o in "MDN=X":
            indel = 0
            if match and more[i]:
                size, other = ops[i + 2] if ops[i + 1][1] == "P" else ops[i + 1]
                indel = size if other == "I" else -size if other == "D" else 0
            out.append((ref, query, n, o, indel, match and not seen, match and not more[i]))
        seen = match or (seen and o not in "NSH")
        ref += n if o in "MDN=X" else 0
        query += n if o in "MIS=X" else 0
    return out


_AROUND = pa.struct([("ref", pa.int64()), ("query", pa.int64()), ("len", pa.int32()), ("op", pa.string()), ("indel", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])


def blocks_around(cigar: Column) -> Column:
    """blocks() with neighbourhood()'s fields, of CIGAR texts and from position 0 on. Each text that a batch has is worked out once."""

    @F.arrow_udf("array<struct<ref:bigint,query:bigint,len:int,op:string,indel:int,first:boolean,last:boolean>>")
    def run(texts: pa.Array) -> pa.Array:
        each = texts.dictionary_encode()
        found = [_around(t) for t in each.dictionary.to_pylist()]
        at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        rows = list(zip(*(b for one in found for b in one))) or [()] * _AROUND.num_fields
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _AROUND)], fields=list(_AROUND))
        return pa.ListArray.from_arrays(at, flat).take(each.indices)

    return run(cigar)


def blocks(ops: Column, pos: Column, also: dict[str, str] | None = None) -> Column:
    """Aligned stretches: array of (ref, query, len, op) for M, =, X, D and N, from the 0-based position on, and fields that the operations have besides (name to type)."""
    more = also or {}
    fields = "".join(f",{n}:{t}" for n, t in more.items())
    start = F.struct(pos.cast("long").alias("ref"), F.lit(0).cast("long").alias("query"), F.array().cast(f"array<struct<ref:bigint,query:bigint,len:int,op:string{fields}>>").alias("out"))

    def step(s: Column, o: Column) -> Column:
        on_ref, on_query = o["op"].isin("M", "D", "N", "=", "X"), o["op"].isin("M", "I", "S", "=", "X")
        own = F.struct(s["ref"].alias("ref"), s["query"].alias("query"), o["len"].alias("len"), o["op"].alias("op"), *(o[n].alias(n) for n in more))
        return F.struct(
            (s["ref"] + F.when(on_ref, o["len"]).otherwise(0)).alias("ref"),
            (s["query"] + F.when(on_query, o["len"]).otherwise(0)).alias("query"),
            F.when(o["op"].isin("M", "D", "N", "=", "X"), F.concat(s["out"], F.array(own))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda s: s["out"])


def build(length: Column, left: Column, right: Column, gap_at: Column | None = None, gap: Column | None = None) -> Column:
    """Clips around one match, or around two with a skipped stretch of the reference between them."""
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    middle = part(length, "M") if gap_at is None else F.concat(part(gap_at, "M"), part(gap, "N"), part(length - gap_at, "M"))
    return F.concat(part(left, "S"), middle, part(right, "S"))


def ucsc_bin(begin: Column, end: Column) -> Column:
    """The smallest bin of the hierarchical binning scheme that holds [begin, end)."""
    last = end - 1
    found = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        found = F.when(F.shiftright(begin, shift) == F.shiftright(last, shift), first + F.shiftright(begin, shift)).otherwise(found)
    return found.cast("int")


def mismatch_text(read: Column, reference: Column) -> Column:
    """Run lengths of matches with the reference's base at each mismatch, for an alignment without indels."""
    step = lambda s, i: F.when(F.substr(read, i, F.lit(1)) == F.substr(reference, i, F.lit(1)), F.struct((s["n"] + 1).alias("n"), s["out"].alias("out"))).otherwise(F.struct(F.lit(0).alias("n"), F.concat(s["out"], s["n"].cast("string"), F.substr(reference, i, F.lit(1))).alias("out")))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.length(read)), start, step, lambda s: F.concat(s["out"], s["n"].cast("string")))


def reversed_text(cigar: Column) -> Column:
    """The operations of a CIGAR text in the other direction."""
    return text(F.reverse(operations(cigar)))
