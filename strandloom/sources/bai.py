"""Index of sorted BAM files by place: made by tasks, written in the usual form, and regions read through it.

A file is cut into ranges of bytes. A task finds the first whole block of its range and in it the first record (as bam.read_bam does), and follows records up to the first that begins beyond its range, so each record is one task's. Each range tells where its first record begins and where
the one after its last begins; a range must begin where the one before ended, so a wrong guess is an error and never an index. A record's place in the file is its block's first byte times 2**16 and its place in what the block holds.

What tasks tell is summed up before it is shuffled: the chunks of each bin, merged where they meet within a block, the first record of each window of 2**14 positions, and numbers of records. A region's reader takes the chunks of all bins that may
hold something of it, leaves out what ends before the first record of its first window, and opens nothing else.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.kept import kept
from strandloom.sources import bam as B
from strandloom.sources.ranged import Ranged, located, named, ranges

#: Positions of a window are 2**WINDOW; bytes that tasks of an index and of a region's long chunks read.
WINDOW, RANGE, PIECE = 14, 128 << 20, 16 << 20
# Fixed values of the format: shifts and first numbers of the bins of each level, the bin that holds counts, and the end of positions.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
COUNTS_BIN, LAST = 37450, 1 << 29


def block_at(file: Ranged, at: int) -> tuple[bytes, int]:
    """What the block at `at` holds, and how many bytes it has."""
    need: bytes | int | None = 12
    size = 12
    while isinstance(need, int):
        size = need
        data = file.bytes(at, size)
        if len(data) < size:
            need = None
            break
        need = B.block_of(data)
    if need is None:
        raise ValueError(f"no whole block at byte {at} of {file.path}")
    return need, size


def first_block(file: Ranged, start: int, stop: int) -> int | None:
    """Where the first block of a range begins: at a mark from which size, checksum and length agree."""
    at = start
    while at < stop:
        part = file.bytes(at, min(1 << 16, stop - at) + len(B.MARK) - 1)
        found = part.find(B.MARK)
        if found < 0:
            at += max(1, len(part) - len(B.MARK) + 1)
            continue
        at += found
        try:
            block_at(file, at)
            return at
        except ValueError:
            at += 1
    return None


class _Bytes:
    """What blocks hold from one on, with where in the file each byte comes from."""

    def __init__(self, file: Ranged, at: int):
        self.file, self.next = file, at
        self.data = bytearray()
        self.begins: list[int] = []
        self.places: list[int] = []

    def more(self) -> bool:
        """Adds a block that isn't empty, if there is one."""
        while self.next < self.file.size:
            place = self.next
            held, size = block_at(self.file, place)
            self.next += size
            if held:
                self.begins.append(len(self.data))
                self.places.append(place)
                self.data += held
                return True
        return False

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.begins = [b - n for b in self.begins]
        used = max(0, bisect_right(self.begins, 0) - 1)
        self.begins, self.places = self.begins[used:], self.places[used:]

    def virtual(self, at: list[int]) -> np.ndarray:
        """Places in the file; the end of what is there is the end of the file."""
        begins, places = np.array([*self.begins, len(self.data)], np.int64), np.array([*self.places, self.file.size], np.int64)
        i = np.searchsorted(begins, at, "right") - 1
        return places[i] << 16 | np.array(at, np.int64) - begins[i]

    def header(self) -> bytes:
        """The header of a file that is read from its beginning."""
        end = None
        while end is None:
            if not self.more():
                raise ValueError(f"{self.file.path} ends within its header")
            if self.data[:4] != b"BAM\1":
                raise ValueError(f"{self.file.path} isn't BAM")
            end = B.header_end(self.data)
        found = bytes(self.data[:end])
        self.skip(end)
        return found

    def records(self, at: int, stop: int, size: int = B.SLICE) -> Iterator[tuple[bytes, list[int], np.ndarray]]:
        """Records that begin before the place `stop`, by slices: bytes, where records begin, and their places in the file with that of what follows."""
        self.skip(at)
        while True:
            there = True
            while there and len(self.data) < size and self.next <= stop >> 16:  # later blocks hold at most the rest of a record
                there = self.more()
            starts, end = B._starts(self.data, 0)
            while not starts and there:
                there = self.more()
                starts, end = B._starts(self.data, 0)
            if end == len(self.data):
                there = self.more()
            if not there and not starts and self.data:
                raise ValueError(f"{self.file.path} ends within a record")
            places = self.virtual([*starts, end])
            n = int(np.searchsorted(places[:-1], stop))
            yield bytes(self.data), starts[:n], places[: n + 1]
            if not starts or places[n] >= stop:
                return
            self.skip(end)


def header_of(path: str) -> bytes:
    with Ranged(path) as file:
        return _Bytes(file, 0).header()


# Making an index

_TOLD = "path string, start long, kind string, tid int, key long, lo long, hi long, n long, m long"
_FIELDS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("tid", pa.int32()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])


def bins_of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin that holds each [begin, end)."""
    return np.select([begin >> s == end - 1 >> s for s, _ in LEVELS], [first + (begin >> s) for s, first in LEVELS], 0)


class _Sums:
    """Chunks, windows and counts of the records of a range, in their order."""

    def __init__(self):
        self.chunks: dict[tuple[int, int], list[list[int]]] = {}
        self.windows: dict[tuple[int, int], int] = {}
        self.counts: dict[int, list[int]] = {}
        self.spans: dict[bytes, int] = {}
        self.first = self.last = None

    def span(self, ops: bytes) -> int:
        if (n := self.spans.get(ops)) is None:
            if len(self.spans) > 1 << 16:
                self.spans.clear()
            n = self.spans[ops] = sum(o >> 4 for o in struct.unpack(f"<{len(ops) // 4}I", ops) if B._OPS[o & 15] in "MDN=X") or 1
        return n

    def add(self, data: bytes, starts: list[int], places: np.ndarray) -> None:
        at = np.array(starts, np.int64)
        f = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(36)].copy().view("<i4").astype(np.int64).reshape(len(at), 9)
        tid, pos, name, more = f[:, 1], f[:, 2], f[:, 3] & 0xFF, f[:, 4]
        order = np.where(tid < 0, 1 << 62, tid << 32 | pos + 1)
        if (np.diff(order) < 0).any() or (self.last is not None and order[0] < self.last):
            raise ValueError("records aren't in order of contig and position")
        self.first, self.last = int(order[0]) if self.first is None else self.first, int(order[-1])
        ops = (at + 36 + name).tolist()
        length = np.array([self.span(data[a : a + 4 * n]) for a, n in zip(ops, (more & 0xFFFF).tolist())], np.int64)
        begin = np.maximum(pos, 0)
        end = begin + length
        for t in np.unique(tid).tolist():
            own = tid == t
            lost = int((more[own] >> 18 & 1).sum())
            sums = self.counts.setdefault(t, [int(places[:-1][own][0]), 0, 0, 0])
            sums[1] = int(places[1:][own][-1])
            sums[2] += int(own.sum()) - lost
            sums[3] += lost
        placed = np.flatnonzero(tid >= 0)
        if not len(placed):
            return
        if (end[placed] > LAST).any():
            raise ValueError("a record lies beyond what an index of this form can tell")
        bins = bins_of(begin, end)
        tid, begin, end, bins = tid[placed], begin[placed], end[placed], bins[placed]
        lo, hi = places[:-1][placed], places[1:][placed]
        turn = np.flatnonzero(np.concatenate([[True], (np.diff(tid) != 0) | (np.diff(bins) != 0)]))
        for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(tid)]):
            chunks = self.chunks.setdefault((int(tid[a]), int(bins[a])), [])
            if chunks and chunks[-1][1] >> 16 >= int(lo[a]) >> 16:
                chunks[-1][1] = int(hi[b - 1])
            else:
                chunks.append([int(lo[a]), int(hi[b - 1])])
        n = (end - 1 >> WINDOW) - (begin >> WINDOW) + 1
        which, _ = B._ranges(begin >> WINDOW, n)
        keys, seen = np.unique(np.repeat(tid, n) << 32 | which, return_index=True)
        for key, place in zip(keys.tolist(), np.repeat(lo, n)[seen].tolist()):
            self.windows.setdefault((key >> 32, key & 0xFFFFFFFF), place)

    def rows(self) -> Iterator[tuple]:
        for (t, b), chunks in self.chunks.items():
            for lo, hi in chunks:
                yield "bin", t, b, lo, hi, None, None
        for (t, w), lo in self.windows.items():
            yield "window", t, w, lo, None, None, None
        for t, (lo, hi, mapped, lost) in self.counts.items():
            yield "counts", t, None, lo, hi, mapped, lost


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            with Ranged(path) as file:
                rows = list(_summed(file, start, stop))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([start] * len(rows), pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_FIELDS)[2:]))], schema=_FIELDS)


def _summed(file: Ranged, start: int, stop: int) -> Iterator[tuple]:
    """Rows of one range, and one of kind edge: where its records begin and what follows begins (lo, hi; null without records), and the first and last record's order."""
    sums, at = _Sums(), first_block(file, start, stop)
    lo = hi = None
    if start == 0 and at != 0:
        raise ValueError(f"{file.path} isn't a file of blocks")
    if at is not None:
        held, first = _Bytes(file, at), 0
        if start == 0:
            held.header()
        else:
            there, first = held.more(), None
            while first is None and held.data:
                for _ in range(max(1, len(held.places))):
                    there = there and held.more()
                first = B.first_record(bytes(held.data), not there)
                if not there or len(held.data) > 1 << 28:
                    break
        if first is not None:
            for data, starts, places in held.records(first, stop << 16):
                if starts:
                    lo = int(places[0]) if lo is None else lo
                    hi = int(places[-1])
                    sums.add(data, starts, places)
    yield from sums.rows()
    yield "edge", None, None, lo, hi, sums.first, sums.last


def index_of(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Index of BAM files sorted by place, made in ranges of `size` bytes: path, kind, tid, key, lo, hi, n, m. Kinds: bin (a chunk of bin `key`), window (the first record of window `key`), counts (first and last place, mapped and unmapped records; tid -1: those without a place).

    Files that aren't sorted, are damaged or of another form raise an error."""
    told = kept(ranges(spark, path, size).mapInArrow(_scanned, _TOLD), "bai")
    edges = told.where("kind = 'edge' and lo is not null")
    own = Window.partitionBy("path").orderBy("start")  # a row for each range of a file
    seams = edges.select("path", "start", "lo", F.lag("hi").over(own).alias("upto"), "n", F.lag("m").over(own).alias("before"))
    for r in seams.where("lo <> upto or n < before").limit(1).collect():
        raise ValueError(f"records of {r.path} aren't in order or don't follow each other at byte {r.start}")
    chunks = told.where("kind = 'bin'")
    by_bin = Window.partitionBy("path", "tid", "key").orderBy("lo", "hi")
    upto = F.max("hi").over(by_bin.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(upto.isNull() | (F.shiftright(upto, 16) < F.shiftright("lo", 16)), 1).otherwise(0)
    runs = chunks.withColumn("new", new).withColumn("run", F.sum("new").over(by_bin)).groupBy("path", "kind", "tid", "key", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")
    rest = told.where("kind in ('window', 'counts')").groupBy("path", "kind", "tid", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    return kept(runs.withColumns({"n": F.lit(None).cast("long"), "m": F.lit(None).cast("long")}).unionByName(rest), "bai")


def write_bai(index: DataFrame, path: str, to: str) -> None:
    """The index of one file in the usual form. Rows come to the driver in order, a partition at a time, and go to the file."""
    n_ref = len(B.contigs_of(header_of(path)))
    section = F.when(F.col("kind") == "bin", 0).when(F.col("kind") == "counts", 1).otherwise(2)
    own = index.where(F.col("path") == named(path)).withColumn("section", section)
    sums = own.groupBy("tid").agg(F.count_distinct(F.when(F.col("section") == 0, F.col("key"))).alias("bins"), F.max(F.when(F.col("section") == 2, F.col("key") + 1)).alias("windows"))
    rows = own.withColumn("chunks", F.count("*").over(Window.partitionBy("tid", "section", "key"))).join(sums, "tid").select("tid", "section", "key", "lo", "hi", "n", "m", "chunks", "bins", "windows").orderBy("tid", "section", "key", "lo")
    store, inner = located(to)
    empty, after, lost = struct.pack("<ii", 0, 0), 0, 0
    with store.open_output_stream(inner) as out:
        out.write(b"BAI\1" + struct.pack("<i", n_ref))
        for r in rows.toLocalIterator():
            if r.tid < 0:
                lost = r.n + r.m
                continue
            if r.tid >= after:  # its first row
                out.write(empty * (r.tid - after) + struct.pack("<i", r.bins + 1))
                after, bin_, window, place = r.tid + 1, None, 0, 0
            if r.section == 0:
                if r.key != bin_:
                    bin_ = r.key
                    out.write(struct.pack("<Ii", r.key, r.chunks))
                out.write(struct.pack("<QQ", r.lo, r.hi))
            elif r.section == 1:
                out.write(struct.pack("<IiQQQQi", COUNTS_BIN, 2, r.lo, r.hi, r.n, r.m, r.windows))
            else:  # a window without records has the place of the one before it
                out.write(struct.pack("<Q", place) * (r.key - window) + struct.pack("<Q", r.lo))
                window, place = r.key + 1, r.lo
        out.write(empty * (n_ref - after) + struct.pack("<Q", lost))


# Reading through an index


def bins_overlapping(begin: int, end: int) -> set[int]:
    """Bins that may hold something of [begin, end)."""
    end = min(end, LAST)
    return {0}.union(*(range(first + (begin >> s), first + (end - 1 >> s) + 1) for s, first in LEVELS)) if begin < end else set()


def chunks(bai: str, regions: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What regions (tid, begin, end) must read: (number of the region, first place, last place), long chunks cut where records of windows begin. An index is read one contig at a time."""
    asked: dict[int, list[int]] = {}
    for i, (tid, begin, end) in enumerate(regions):
        if begin < end:
            asked.setdefault(tid, []).append(i)
    out: list[tuple[int, int, int]] = []
    with Ranged(bai) as file:
        if file.bytes(0, 4) != b"BAI\1":
            raise ValueError(f"{bai} isn't an index of this form")
        n_ref, at = struct.unpack("<i", file.bytes(4, 4))[0], 8
        for tid in range(min(n_ref, max(asked, default=-1) + 1)):
            n_bin = struct.unpack("<i", file.bytes(at, 4))[0]
            at += 4
            bins: dict[int, list[tuple[int, int]]] = {}
            for _ in range(n_bin):
                key, n = struct.unpack("<Ii", file.bytes(at, 8))
                if tid in asked:
                    bins[key] = list(struct.iter_unpack("<QQ", file.bytes(at + 8, 16 * n)))
                at += 8 + 16 * n
            n = struct.unpack("<i", file.bytes(at, 4))[0]
            windows = np.frombuffer(file.bytes(at + 4, 8 * n), "<u8").astype(np.int64) if tid in asked else None
            at += 4 + 8 * n
            for i in asked.get(tid, ()):
                _, begin, end = regions[i]
                begin = max(0, begin)
                least = int(windows[min(begin >> WINDOW, len(windows) - 1)]) if len(windows) else 0
                found = sorted((max(lo, least), hi) for key in bins_overlapping(begin, end) for lo, hi in bins.get(key, ()) if hi > least)
                joined: list[list[int]] = []
                for lo, hi in found:
                    if joined and joined[-1][1] >> 16 >= lo >> 16:
                        joined[-1][1] = max(joined[-1][1], hi)
                    else:
                        joined.append([lo, hi])
                marks = np.unique(windows)
                for lo, hi in joined:
                    for mark in marks[(marks > lo) & (marks < hi)].tolist():
                        if (mark >> 16) - (lo >> 16) >= PIECE:
                            out.append((i, lo, mark))
                            lo = mark
                    out.append((i, lo, hi))
    return out


def _region_records(path: str, names: list[str], regions: list[tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[bytes, str] = {}
        for batch in batches:
            with Ranged(path, 1 << 16) as file:
                for region, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                    yield from found_in(file, region, lo, hi, names, regions[region], shapes)

    return run


def found_in(file: Ranged, region: int, lo: int, hi: int, names: list[str], where: tuple[int, int, int], shapes: dict[bytes, str]) -> Iterator[pa.RecordBatch]:
    """Records of a chunk that overlap a region."""
    tid, begin, end = where
    held = _Bytes(file, lo >> 16)
    held.more()
    for data, starts, _ in held.records(lo & 0xFFFF, hi, 1 << 16):
        own = []
        past = False
        for at in starts:
            _, t, p, name, more = struct.unpack_from("<iiiII", data, at)
            past = t != tid or p >= end
            if past:
                break
            ops = data[at + 36 + (name & 0xFF) : at + 36 + (name & 0xFF) + 4 * (more & 0xFFFF)]
            span = sum(o >> 4 for o in struct.unpack(f"<{len(ops) // 4}I", ops) if B._OPS[o & 15] in "MDN=X") or 1
            if p + span > begin:
                own.append(at)
        if own:
            columns = dict(zip([n for n, _ in B._ARROW], B.decoded(data, own, shapes)))
            t, m = columns.pop("tid").to_pylist(), columns.pop("mtid").to_pylist()
            columns["rname"] = pa.array([names[x] for x in t])
            columns["rnext"] = pa.array(["=" if x == y else "*" if y < 0 else names[y] for x, y in zip(t, m)])
            yield pa.RecordBatch.from_arrays([pa.array([region] * len(own), pa.int32()), *(columns[c] for c in [*B.COLUMNS, "tags"])], ["region", *B.COLUMNS, "tags"])
        if past:
            return


def in_regions(spark: SparkSession, path: str, bai: str, regions: list[tuple[str, int, int]]) -> DataFrame:
    """Records of a sorted BAM file that overlap regions (contig, begin, end; 0-based, half open), with the region's number in the list; a record that overlaps several is told for each. Tasks open the regions' chunks and nothing else. A contig that the file lacks raises an error.

    Regions are a user's list and go to the driver as such, with their chunks."""
    contigs = [n for n, _ in B.contigs_of(header_of(path))]
    tid = {n: i for i, n in enumerate(contigs)}
    if unknown := {c for c, _, _ in regions} - set(tid):
        raise ValueError(f"no such contig in {path}: {', '.join(sorted(unknown))}")
    numbered = [(tid[c], max(0, b), e) for c, b, e in regions]
    found = chunks(bai, numbered)
    ddl = "region int, " + ", ".join(f"{c} {k}" for c, k in zip(B.COLUMNS, B.KINDS)) + ", tags map<string, struct<code: string, value: string>>"
    rows = spark.createDataFrame(found, "region int, lo long, hi long").repartition(max(1, min(len(found), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return rows.mapInArrow(_region_records(path, contigs, numbered), ddl)


def write_sorted_bam(records: DataFrame, contigs: list[tuple[str, int]], path: str, header: str = "") -> None:
    """bam.write_bam with records in order of contig (as listed) and position, those without a place last; ranges of places are dealt to tasks. The header says that the file is sorted."""
    place = records.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(contigs)] or [("*", 0)], "rname string, _tid int")
    met = records.join(F.broadcast(place), "rname", "left").withColumn("_tid", F.coalesce("_tid", F.lit(2**31 - 1)))
    dealt = met.repartitionByRange("_tid", "pos", "qname").sortWithinPartitions("_tid", "pos", "qname")
    head = re.sub(r"^@HD.*\n", "", header)
    B.write_bam(dealt, contigs, path, "@HD\tVN:1.0\tSO:coordinate\n" + head)


def joined(spark: SparkSession, folder: str, to: str) -> None:
    """The files of a folder that bam.write_bam wrote as one file, copied piece by piece."""
    names = sorted(r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").collect())  # one for each task that wrote
    store, inner = located(to)
    with store.open_output_stream(inner) as out:
        for name in names:
            with Ranged(name) as part:
                for at in range(0, part.size, 1 << 22):
                    out.write(part.file.read_at(min(1 << 22, part.size - at), at))
        out.write(B.END_BLOCK)
