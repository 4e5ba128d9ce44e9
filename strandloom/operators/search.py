"""Approximate search of reads in contigs.

A read with at most e differences at a place has e + 1 disjoint pieces of which one is the same there. So: pieces of the reads are
keys; the contigs are read once, and only positions whose word is one of the keys go on, each with the part of the contig that a read can cover;
they meet the pieces by an equi-join, whole reads are compared, and the best strata are chosen. Pieces of up to `FEW` bytes are broadcast, so windows aren't shuffled; of more, keys that many rows of both sides have are split by AQE's skew join.
The set of keys that filters the contigs is a bitmap of 2**`BITMAP` bits at most (wider keys by a hash), whatever the number of reads is.
Where a hit needs more of its contig, it meets a tile of it, never the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandloom.config import SearchConf
from strandloom.functions import seq as S
from strandloom.operators.contigs import SLICE, _recoded, letters, of_rows, sliced, tiled, with_parts
from strandloom.operators.kept import kept
from strandloom.operators.seeds import WIDEST, Index, arrays, neighbours, packed

#: The bitmap of keys has at most 2**BITMAP bits (2 MB).
BITMAP = 24
#: Positions of a contig that are looked at together, and bases of windows in a batch.
CHUNK, WINDOWS = 1 << 17, 1 << 21
#: Bytes of pieces with their reads that go to all tasks; where there are more, both sides are shuffled.
FEW = 1 << 25
#: Bytes that a word to look up in an index takes.
PROBE = 48


def budgeted(conf: SearchConf, seq: str = "seq") -> Column:
    """The number of errors that a read may have."""
    return (S.error_budget(F.length(seq), conf.errors_rate) if conf.auto_errors else F.lit(conf.errors)).cast("int")


def budget(reads: DataFrame, conf: SearchConf) -> DataFrame:
    """Adds max_errors; leaves out reads with more N than that, and empty ones."""
    return reads.where(F.length("seq") > 0).withColumn("max_errors", budgeted(conf)).where(S.n_count(F.col("seq")) <= F.col("max_errors"))


def strands(reads: DataFrame) -> DataFrame:
    """Each read on both strands: adds strand and pattern."""
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("pattern")), F.struct(F.lit("-").alias("strand"), S.revcomp(F.col("seq")).alias("pattern")))
    return reads.withColumn("s", F.explode(both)).select("*", "s.*").drop("s")


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the bitmap for keys of so many bits: themselves, or a hash of them."""
    return keys if bits <= BITMAP else ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP)).astype(np.int64)


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[start:end], copied by one array operation."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def _windows(k: int, longest: int, two: bool, bitmap: np.ndarray, prose: bool = False):
    """Contigs, or texts that are recoded first, to the windows around the places whose words are in the bitmap."""
    bits = k * (1 if two else 2)
    most = max(1, WINDOWS // max(1, 2 * longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _recoded(batches) if prose else sliced(batches, SLICE):
            data, ends = letters(batch.column(1))
            if len(data) and data.max() > 127:
                data, ends = letters(pa.array([(x or "").encode("ascii", "replace").decode() for x in batch.column(1).to_pylist()], pa.string()))
            # All contigs of the slice in a row; words that go over the end of one aren't any.
            for lo in range(0, max(0, len(data) - k + 1), CHUNK):
                keys, valid = packed(data[lo : lo + CHUNK + k - 1], k, two)
                slot = slots(keys, bits)
                places = np.flatnonzero(valid & (bitmap[slot >> 3] >> (slot & 7) & 1).astype(bool))
                row = np.searchsorted(ends, places + lo, "right") - 1
                whole = places + lo + k <= ends[row + 1]
                places, row = places[whole], row[whole]
                for i in range(0, len(places), most):
                    key, own = keys[places[i : i + most]], row[i : i + most]
                    at = places[i : i + most] + lo
                    start = np.maximum(ends[own], at - longest)
                    held.append(pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(own)), pa.array(at - ends[own]), pa.array(start - ends[own]), _gathered(data, start, np.minimum(ends[own + 1], at + longest))], ["key", "contig_id", "at", "window_start", "window"]))
                if sum(b.num_rows for b in held) > most:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _compared(bisulfite: bool):
    """Adds nm, the differences of pattern and part, and leaves out rows with more than max_errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at), (b, bt) = letters(batch.column("pattern")), letters(batch.column("part"))
            minus = pc.equal(batch.column("strand"), "-").to_numpy(zero_copy_only=False)
            if not len(a):
                nm = np.zeros(batch.num_rows, np.int32)
            elif max(a.max(), b.max()) > 127:  # letters of more than a byte
                free = [("A", "G") if m else ("T", "C") for m in minus]
                pairs = zip(batch.column("pattern").to_pylist(), batch.column("part").to_pylist(), free)
                nm = np.array([sum(x != y and not (bisulfite and (x, y) == f) for x, y in zip(p, w)) for p, w, f in pairs], np.int32)
            else:
                differ = a != b
                if bisulfite:
                    other = np.repeat(minus, np.diff(at))
                    differ &= ~np.where(other, (a == ord("A")) & (b == ord("G")), (a == ord("T")) & (b == ord("C")))
                upto = np.concatenate(([0], np.cumsum(differ)))
                nm = (upto[at[1:]] - upto[at[:-1]]).astype(np.int32)
            near = pa.array(nm <= batch.column("max_errors").to_numpy())
            names = ["read_id", "contig_id", "pos", "strand", "max_errors"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(nm)], [*names, "nm"]).filter(near)

    return run


def _pieces(k: int, two: bool):
    bits = k * (1 if two else 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, offsets = [], [], []
            for i, (pattern, errors) in enumerate(zip(batch.column("pattern").to_pylist(), batch.column("max_errors").to_pylist())):
                size = len(pattern) // (errors + 1)
                if size >= k:
                    found, valid = packed(pattern.encode("ascii", "replace"), k, two)
                    for p in range(errors + 1):
                        if valid[p * size]:
                            keys.append(int(found[p * size]))
                            rows.append(i)
                            offsets.append(p * size)
            key = np.array(keys, np.int64)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(key), pa.array(offsets, pa.int64()), pa.array(slots(key, bits))], [*batch.schema.names, "key", "offset", "slot"])

    return run


def _balls(k: int, two: bool):
    """Pieces as wide as an index's seeds, as many as a read has room for or needs, and every word with as many differences as one of them has at most. An N is a difference wherever it stands, so any letter may stand for it."""
    bits, letters_ = k * (1 if two else 2), 2 if two else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                keys, rows, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, (read, pattern, errors) in enumerate(zip(some.column("read_id").to_pylist(), some.column("pattern").to_pylist(), some.column("max_errors").to_pylist())):
                    n = min(errors + 1, len(pattern) // k)
                    if n:
                        radius = errors // n
                        if radius > 2:
                            raise ValueError(f"the index doesn't fit read {read}")
                        if radius not in masks:
                            masks[radius] = np.array([m for m, _ in neighbours(k, radius, letters_)], np.int64)
                        found, _ = packed(re.sub("[^ACGT]", "A", pattern).encode(), k, two)
                        at = np.arange(n) * (len(pattern) // n)
                        near = found[at][:, None] ^ masks[radius]
                        keys.append(near.ravel())
                        offsets.append(np.repeat(at, near.shape[1]))
                        rows.append(np.full(near.size, i))
                key, row = np.concatenate(keys), pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([some.column("read_id").take(row), some.column("strand").take(row), pa.array(key), pa.array(np.concatenate(offsets)), pa.array(slots(key, bits))], ["read_id", "strand", "key", "offset", "slot"])

    return run


def probes(both: DataFrame, k: int, two: bool) -> DataFrame:
    """Patterns (with max_errors) to the keys to look up in an index of width k: read_id, strand, key, offset, slot, a row for every word within the radius that one of the pieces must keep to. A radius over 2 fails."""
    return both.mapInArrow(_balls(k, two), f"read_id {both.schema['read_id'].dataType.simpleString()}, strand string, key long, offset long, slot long")


def _looked_up(k: int, two: bool, longest: int, bitmap: np.ndarray):
    """Blocks of an index to the windows around its places whose keys are in the bitmap, as _windows."""
    bits = k * (1 if two else 2)
    most = max(1, WINDOWS // max(1, 2 * longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                contigs, begins, offsets, keys, firsts, places = (np.frombuffer(batch.column(c)[r].as_buffer(), kind) for c, kind in arrays(bits).items())
                text = np.frombuffer(batch.column("text")[r].as_buffer(), np.uint8)
                slot = slots(keys.astype(np.int64), bits)
                found = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7) & 1)
                n = firsts[found + 1] - firsts[found]
                upto = np.cumsum(n)
                at_all = places[np.arange(upto[-1] if len(upto) else 0) + np.repeat(firsts[found] - (upto - n), n)].astype(np.int64)
                key_all = np.repeat(keys[found].astype(np.int64), n)
                for i in range(0, len(at_all), most):
                    at = at_all[i : i + most]
                    part = np.searchsorted(offsets, at, "right") - 1
                    start, shift = np.maximum(offsets[part], at - longest), begins[part] - offsets[part]
                    yield pa.RecordBatch.from_arrays([pa.array(key_all[i : i + most]), pa.array(contigs[part]), pa.array(at + shift), pa.array(start + shift), _gathered(text, start, np.minimum(offsets[part + 1], at + longest))], ["key", "contig_id", "at", "window_start", "window"])

    return run


def patterns(reads: DataFrame) -> DataFrame:
    return strands(reads.select("read_id", "seq", "max_errors")).select("read_id", "strand", "pattern", "max_errors")


def pieces_of(reads: DataFrame, k: int, two: bool) -> DataFrame:
    """Reads (read_id, seq, max_errors) on both strands to the pieces that they are looked up by: read_id, strand, pattern, max_errors, key, offset, slot."""
    both = patterns(reads)
    return both.mapInArrow(_pieces(k, two), f"{_ddl(both)}, key long, offset long, slot long")


def bitmap_of(pieces: DataFrame, bits: int, each: Column) -> tuple[np.ndarray, int]:
    """The slots of all pieces as bits, and the sum of `each`, the pieces' sizes in bytes; they come to the driver in words of 64, so at most 2**(BITMAP - 6) rows."""
    size = min(bits, BITMAP)
    held = F.sum(each.cast("long")).alias("size")
    words = pieces.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))).alias("bits"), held).toArrow()
    out = np.zeros(max(1, 1 << max(0, size - 6)), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8), pc.sum(words.column("size")).as_py() or 0


def candidates(reads: DataFrame, contigs: DataFrame, k: int, two: bool = False, index: Index | None = None, slack: int | None = None) -> DataFrame:
    """Reads (read_id, seq, max_errors) and contigs (contig_id, seq; or as contigs.prose has them), or an index of them, to the places where a piece is the same: read_id, strand, pattern, max_errors, contig_id, pos, part. A place that several pieces lead to is told for each of them.

    A place whose read would begin before its contig or end after it is left out. With `slack` it may by so many bases; then part has so many more on both sides, as far as the contig goes."""
    found = ["read_id", "strand", "pattern", "max_errors", "contig_id", "pos"]
    more = slack or 0
    begin = F.greatest(F.col("pos") - more, F.lit(0))
    size = (F.col("pos") + F.length("pattern") + more - begin).cast("int")
    longest = (reads.agg(F.max(F.length("seq"))).first()[0] or 0) + more
    cut = "key long, contig_id long, at long, window_start long, window string"
    if index is not None:
        if longest > index.reach:
            raise ValueError(f"the index is for reads of up to {index.reach} bases")
        # Balls are many rows, so they don't carry the patterns.
        own = patterns(reads)
        balls = probes(own, k, two)
        bitmap, held = bitmap_of(balls, k * (1 if two else 2), F.lit(PROBE))
        sized = own.agg(F.sum(F.octet_length("pattern").cast("long") + PROBE)).first()[0] or 0
        hint = lambda df, n: F.broadcast(df) if n <= FEW else df
        windows = index.blocks.drop("lengths").mapInArrow(_looked_up(k, two, longest, bitmap), cut)
        met = windows.join(hint(balls.drop("slot"), held), "key").join(hint(own, sized), ["read_id", "strand"])
    else:
        pieces = pieces_of(reads, k, two)
        bitmap, held = bitmap_of(pieces, k * (1 if two else 2), F.octet_length("pattern").cast("long") + 64)
        prose = "prose" in contigs.columns
        windows = contigs.select(F.col("contig_id").cast("long"), "prose" if prose else "seq").mapInArrow(_windows(k, longest, two, bitmap, prose), cut)
        pieces = pieces.drop("slot")
        met = windows.join(F.broadcast(pieces) if held <= FEW else pieces, "key")
    met = met.withColumn("pos", F.col("at") - F.col("offset")).where(F.col("pos") >= -more)
    part = F.substr("window", (begin - F.col("window_start") + 1).cast("int"), size)
    if slack is not None:
        return met.withColumn("part", part).where(F.length("part") > 0).select(*found, "part")
    inside = (F.col("pos") >= F.col("window_start")) & (F.length("part") == F.length("pattern"))
    return met.withColumn("part", part).where(inside).select(*found, "part")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def seed_width(reads: DataFrame, widest: int = WIDEST) -> int:
    """The widest seed that every read's pieces have room for."""
    least = reads.agg(F.min(F.floor(F.length("seq") / (F.col("max_errors") + 1)))).first()[0]
    return max(1, min(widest, int(least or 1)))


def hits(reads: DataFrame, contigs: DataFrame | None, conf: SearchConf, k: int | None = None, index: Index | None = None) -> DataFrame:
    """All places with at most max_errors + delta differences: read_id, contig_id, pos (0-based), strand, nm, max_errors."""
    return within(budget(reads, conf), contigs, conf, k, index)


def within(ready: DataFrame, contigs: DataFrame | None, conf: SearchConf, k: int | None = None, index: Index | None = None, watch: Observation | None = None) -> DataFrame:
    """hits() of reads that have their own max_errors. `watch` is told the number of candidates, the places where whole reads are compared."""
    wide = ready.withColumn("max_errors", F.col("max_errors") + conf.delta)
    found = candidates(wide, contigs, index.k if index else k or seed_width(wide), conf.bisulfite, index)
    if watch is not None:
        found = found.observe(watch, F.count(F.lit(1)).alias("candidates"))
    kind = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    near = found.mapInArrow(_compared(conf.bisulfite), f"read_id {kind['read_id']}, contig_id {kind['contig_id']}, pos long, strand string, max_errors int, nm int")
    # Compared first: few of the places that meet a piece by chance are left.
    one = near.dropDuplicates(["read_id", "contig_id", "pos", "strand"])
    return one.select("read_id", "contig_id", "pos", "strand", "nm", (F.col("max_errors") - conf.delta).alias("max_errors"))


def indexed(reads: DataFrame, index: Index, conf: SearchConf = SearchConf()) -> DataFrame:
    """search() over a stored index. Its alphabet must be the search's.

    Reads with a piece as wide as the index's seeds for each difference and one more are looked up by those. Others have fewer pieces, so one of them has errors // pieces differences at most, and all words within that of each piece are looked up; beyond 2, or
    where a read has no such piece or is longer than the index reaches, the plan fails."""
    if index.two != conf.bisulfite:
        raise ValueError("the index is for searches with the other alphabet")
    errors, pieces = budgeted(conf) + conf.delta, F.floor(F.length("seq") / index.k)
    fits = (pieces >= 1) & (F.floor(errors / F.greatest(pieces, F.lit(1))) <= 2) & (F.length("seq") <= index.reach)
    checked = reads.where(F.when((F.length("seq") == 0) | fits, True).otherwise(F.raise_error(F.concat(F.lit("the index doesn't fit read "), F.col("read_id").cast("string")))))
    return strata(hits(checked, None, conf, index=index), conf.delta)


def strata(found: DataFrame, delta: int = 0) -> DataFrame:
    """Of each read the hits of the best stratum and of `delta` more, if the best is within its budget."""
    best = F.min("nm").over(Window.partitionBy("read_id"))
    return found.withColumn("best", best).where((F.col("nm") <= F.col("best") + delta) & (F.col("best") <= F.col("max_errors"))).drop("best")


def search(reads: DataFrame, contigs: DataFrame, conf: SearchConf = SearchConf()) -> DataFrame:
    return strata(hits(reads, contigs, conf), conf.delta)


def staged(reads: DataFrame, contigs: DataFrame, conf: SearchConf) -> DataFrame:
    """The best stratum of each read, looked for with 0, 1, 2 … differences; only reads without a hit go on to the next."""
    left, out = budget(reads, conf), None
    for errors in range(conf.errors + 1):
        stage = SearchConf(errors=errors, bisulfite=conf.bisulfite)
        found = search(left.select("read_id", "seq"), contigs, stage).withColumn("max_errors", F.lit(conf.errors))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("read_id").distinct(), "read_id", "left_anti")
    return out


def numbered(found: DataFrame, first: int | None = None) -> DataFrame:
    """Adds nh (hits of the read), hi (1.. in order of nm, contig, pos, strand) and is_primary; keeps the first `first`."""
    own = Window.partitionBy("read_id")
    out = found.withColumn("nh", F.count("*").over(own)).withColumn("hi", F.row_number().over(own.orderBy("nm", "contig_id", "pos", "strand"))).withColumn("is_primary", F.col("hi") == 1)
    return out if first is None else out.where(F.col("hi") <= first)


def places(found: DataFrame) -> DataFrame:
    """Places that have a hit on either strand, once each. Both strands are of one search, so contigs are read once."""
    return found.select("contig_id", "pos").distinct()


def chosen(found: DataFrame, seed: str = "1") -> DataFrame:
    """One of each read's hits, drawn by a hash, so the same in every run."""
    order = F.md5(F.concat_ws("|", F.lit(seed), "read_id", "contig_id", "pos", "strand"))
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("read_id").orderBy(order))).where("rn = 1").drop("rn")


def histogram(found: DataFrame) -> DataFrame:
    """Hits of each read by number of differences: read_id and an array of (nm, n) in order; strata between with no hit are there with 0."""
    n = found.groupBy("read_id", "nm").agg(F.count("*").alias("n")).groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("nm", "n"))).alias("m"))
    keys = F.map_keys("m")
    all_ = F.sequence(F.array_min(keys), F.array_max(keys))
    return n.select("read_id", F.transform(all_, lambda k: F.struct(k.alias("nm"), F.coalesce(F.try_element_at("m", k), F.lit(0)).alias("n"))).alias("strata"))


def contaminated(reads: DataFrame, contaminants: DataFrame, conf: SearchConf) -> DataFrame:
    """read_id and the contaminant (least contig_id among the best hits) of reads that have one."""
    return search(reads, contaminants, SearchConf(errors=conf.errors, auto_errors=conf.auto_errors, errors_rate=conf.errors_rate)).groupBy("read_id").agg(F.min("contig_id").alias("contaminant"))


def screened(reads: DataFrame, contaminants: DataFrame, conf: SearchConf) -> tuple[DataFrame, DataFrame]:
    """Reads without a hit among the contaminants, and those with one, with it. Both come from one search, which is written."""
    found = kept(contaminated(reads, contaminants, conf), "contaminated")
    return reads.join(found, "read_id", "left_anti"), reads.join(found, "read_id")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """Rows of both with equal keys and right_at - left_at in 0..width: by bins of that width, of which a left row is in two."""
    size = max(1, width + 1)
    bins = left.withColumn("bin", F.explode(F.array(F.floor(F.col(left_at) / size), F.floor(F.col(left_at) / size) + 1)))
    return bins.join(right.withColumn("bin", F.floor(F.col(right_at) / size)), [*keys, "bin"]).where((F.col(right_at) >= F.col(left_at)) & (F.col(right_at) - F.col(left_at) <= width)).drop("bin")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1 << 14) -> DataFrame:
    """Pairs of intervals [begin, end) and [other_begin, other_end) that share a point, by bins of `width`; each pair once."""
    binned = lambda df, b, e: df.where(F.col(e) > F.col(b)).withColumn("bin", F.explode(F.sequence(F.floor(F.col(b) / width), F.floor((F.col(e) - 1) / width))))
    met = binned(left, "begin", "end").join(binned(right, "other_begin", "other_end"), [*keys, "bin"])
    first = F.floor(F.greatest("begin", "other_begin") / width)
    return met.where((F.col("begin") < F.col("other_end")) & (F.col("end") > F.col("other_begin")) & (F.col("bin") == first)).drop("bin")


def gapped(reads: DataFrame, contigs: DataFrame, conf: SearchConf) -> DataFrame:
    """Reads that split into two parts with 0..max_gap bases of the contig between: read_id, contig_id, strand, pos, pos2, len1, nm, nm2, gap; the least total per read.

    The first and last seed_size bases are searched with seed_errors; where both hit in the right order the split with the fewest differences
    is taken (of equals the leftmost, then the least position). The total may not exceed the budget."""
    s = conf.seed_size
    ready = budget(reads, conf).where(F.length("seq") >= 2 * s)
    both = strands(ready.select("read_id", "seq", "max_errors"))
    plain = SearchConf(errors=conf.seed_errors)
    name = F.concat_ws("|", "read_id", "strand")
    # One search for both ends.
    sides = F.array(F.struct(F.concat(F.lit("L"), name).alias("read_id"), F.substring("pattern", 1, s).alias("seq")), F.struct(F.concat(F.lit("R"), name).alias("read_id"), F.right("pattern", F.lit(s)).alias("seq")))
    found = kept(hits(both.select(F.explode(sides).alias("e")).select("e.*"), contigs, plain).where("strand = '+'").select("read_id", "contig_id", "pos"), "ends")
    ends = [found.where(F.col("read_id").startswith(side)).select(F.substr("read_id", F.lit(2)).alias("key"), "contig_id", "pos") for side in "LR"]
    left = ends[0].withColumn("from", F.col("pos") + s).withColumnRenamed("pos", "pos1")
    longest = both.agg(F.max(F.length("pattern"))).first()[0] or 0
    met = range_join(left, ends[1].withColumnRenamed("pos", "right_pos"), ["key", "contig_id"], "from", "right_pos", conf.max_gap + longest)
    rows = met.join(both.withColumn("key", name), "key").withColumn("n", F.length("pattern")).withColumn("gap", F.col("right_pos") + s - F.col("pos1") - F.col("n")).where((F.col("gap") >= 0) & (F.col("gap") <= conf.max_gap))
    # The bases that follow the first part, and those before the end of the last, both from one tile of a contig that has both.
    rows = kept(rows, "gapped")
    rows = with_parts(rows, tiled(of_rows(contigs, rows), longest + conf.max_gap), F.col("pos1"), F.col("n") + F.col("gap"), "span")
    rows = rows.withColumns({"one": F.substr("span", F.lit(1), F.col("n")), "two": F.substr("span", (F.col("gap") + 1).cast("int"), F.col("n"))})
    at = lambda text, i: F.substr(text, i.cast("int"), F.lit(1))
    differ = lambda name: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (at(F.col("pattern"), i) != at(F.col(name), i)).cast("int"))
    rows = rows.withColumn("a", differ("one")).withColumn("b", differ("two"))
    total = lambda x, lo, n: F.aggregate(F.slice(x, lo, n), F.lit(0), lambda t, v: t + v)
    split = F.transform(F.sequence(F.lit(s), F.col("n") - s), lambda c: F.struct((total(F.col("a"), F.lit(1), c) + total(F.col("b"), c + 1, F.col("n") - c)).alias("total"), c.alias("cut"), total(F.col("a"), F.lit(1), c).alias("nm"), total(F.col("b"), c + 1, F.col("n") - c).alias("nm2")))
    rows = rows.withColumn("best", F.array_min(split)).where(F.col("best.total") <= F.col("max_errors"))
    out = rows.select("read_id", "contig_id", "strand", F.col("pos1").alias("pos"), (F.col("pos1") + F.col("best.cut") + F.col("gap")).alias("pos2"), F.col("best.cut").alias("len1"), F.col("best.nm").alias("nm"), F.col("best.nm2").alias("nm2"), "gap", F.col("best.total").alias("total")).distinct()
    least = F.min("total").over(Window.partitionBy("read_id"))
    return out.withColumn("least", least).where("total = least").drop("least", "total")


def locate(points: DataFrame, contigs: DataFrame) -> DataFrame:
    """Points (at, in the coordinate that runs over all contigs with one place between) to contig_id and pos; places between contigs are left out."""
    width = 1 << 16
    spans = contigs.select("contig_id", "global_start", (F.col("global_start") + F.col("length")).alias("global_end"))
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("global_start") / width), F.floor((F.col("global_end") - 1) / width))))
    met = points.withColumn("bin", F.floor(F.col("at") / width)).join(binned, "bin")
    return met.where((F.col("at") >= F.col("global_start")) & (F.col("at") < F.col("global_end"))).withColumn("pos", F.col("at") - F.col("global_start")).drop("bin", "global_start", "global_end")
