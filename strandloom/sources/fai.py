"""Index of FASTA files by offset arithmetic over wrapped lines, and ranges of bases read by their bytes.

All lines of a record but the last have one length, so where a base lies follows from the record's first base, the bases of a line and the bytes of one. A file is cut into ranges of bytes, and a line belongs to the range in which it begins. Lines of one length in a row are one run, so a record is a
few runs however long it is. Records that lie within a range are done in its task; what lies before a range's first header and behind its last is put together by file, at most two pieces for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.kept import kept
from strandloom.sources.ranged import Ranged, located, named, ranges

#: Bytes of a task's range, bases that a task fetches at once.
RANGE, PIECE = 128 << 20, 1 << 20
#: A record of even lines has at most so many runs: blank lines, full ones, a short one, blank ones.
RUNS = 4
FAI = "name string, length long, offset long, line_bases long, line_bytes long"

Run = tuple[int, int, int, int]  # first byte, lines, bases of a line, bytes of a line


def _runs(file: Ranged, start: int, stop: int) -> Iterator[tuple[bytes | None, Run]]:
    """Lines that begin in a range: headers one by one (text and place), others as runs."""
    at, line = start, 0 if start == 0 else None  # where the line that is being read begins; None: before the first
    head, last, carriage = b"", None, False
    if start:
        at -= 1
    while at < file.size:
        data = file.bytes(at, file.window)
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10) + at
        if line is None:
            if not len(ends):
                at += len(data)
                if at >= stop:
                    return
                continue
            line, ends = int(ends[0]) + 1, ends[1:]
            if line >= stop:
                return
        if len(ends) and line < stop:
            begins = np.concatenate([[line], ends[:-1] + 1])
            own = begins < stop
            begins, ends_ = begins[own], ends[own]
            before = np.where(ends_ > begins, ends_ - 1, begins)  # the byte before the line's end
            inside = before >= at
            cr = np.zeros(len(begins), bool)
            cr[inside] = (raw[before[inside] - at] == 13) & (ends_ > begins)[inside]
            if len(cr) and not inside[0]:
                cr[0] = carriage and ends_[0] > begins[0]
            first = np.full(len(begins), last if last is not None else -1, np.int64)
            first[begins >= at] = raw[begins[begins >= at] - at]
            size = ends_ + 1 - begins
            bases = size - 1 - cr
            is_head = first == ord(">")
            turn = np.flatnonzero(np.concatenate([[True], (np.diff(size) != 0) | (np.diff(bases) != 0) | is_head[1:] | is_head[:-1]]))
            for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(size)]):
                run = (int(begins[a]), b - a, int(bases[a]), int(size[a]))
                if is_head[a]:
                    lo = max(0, run[0] - at)
                    yield head + data[lo : int(ends_[a]) - at], run
                else:
                    yield None, run
                head = b""
        if len(ends):
            line, head, last = int(ends[-1]) + 1, b"", None
        if line >= stop:
            return
        rest = data[max(0, line - at) :]
        if rest and last is None:
            last = rest[0]
        if last == ord(">"):
            head += rest
        if rest:
            carriage = rest[-1] == 13
        at += len(data)
    if line is not None and line < min(stop, file.size):  # a last line without an end
        n = file.size - line
        yield (head, (line, 1, n, n + 1)) if last == ord(">") else (None, (line, 1, n - carriage, n + 1))


def _add(runs: list[Run], run: Run) -> None:
    """Puts a run behind others: lines of one length in a row are one run, and so are blank ones of whatever ends. What follows too many runs is left out, as such a record isn't even."""
    if runs and (runs[-1][2:] == run[2:] or not runs[-1][2] + run[2]):
        off, n, bases, size = runs[-1]
        runs[-1] = (off, n + run[1], bases, size)
    elif len(runs) <= RUNS:
        runs.append(run)


def _indexed(name: str, at: int, runs: list[Run], path: str) -> tuple[str, str, int, int, int, int]:
    """A record's row from its runs; `at` is where its lines begin."""
    own = runs[:] if not runs or runs[0][2] else runs[1:]
    if own and not own[-1][2]:
        own.pop()
    short = len(own) < 2 or (len(own) == 2 and own[1][1] == 1 and own[1][2] <= own[0][2])
    if not short or len(runs) > RUNS or not all(r[2] for r in own):
        raise ValueError(f"lines of {name} in {path} don't have one length")
    if not own:
        return path, name, 0, at, 0, 0
    return path, name, sum(n * bases for _, n, bases, _ in own), own[0][0], own[0][2], own[0][3]


def _name(head: bytes) -> str:
    return (head[1:].decode().split(None, 1) or [""])[0] if head[1:2].strip() else ""


_RUN = pa.list_(pa.struct([("off", pa.int64()), ("n", pa.int64()), ("bases", pa.int64()), ("size", pa.int64())]))
_OUT = pa.schema([("path", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("offset", pa.int64()), ("line_bases", pa.int64()), ("line_bytes", pa.int64()), ("start", pa.int64()), ("runs", _RUN)])
_DDL = f"path string, {FAI}, start long, runs array<struct<off: bigint, n: bigint, bases: bigint, size: bigint>>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)


def pieces_of(file: Ranged, path: str, start: int, stop: int) -> Iterator[tuple]:
    """Rows of _OUT: records that lie within a range, with `runs` null, and its pieces, with the header's name and the place behind it if they have one."""
    name = at = None
    runs: list[Run] = []
    first = True

    def piece():
        return (path, name, None, at, None, None, start if first else start + 1, [dict(zip(("off", "n", "bases", "size"), r)) for r in runs])

    for head, run in _runs(file, start, stop):
        if head is None:
            _add(runs, run)
            continue
        if name is not None:
            yield (*_indexed(name, at, runs, path), None, None)
        elif runs:
            yield piece()
        name, at, runs, first = _name(head), run[0] + run[3], [], False
    if name is not None or runs:
        yield piece()


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            if path.endswith((".gz", ".bz2", ".zst")):
                raise ValueError(f"{path} is compressed: bytes don't tell where bases are")
            held: list[tuple] = []
            with Ranged(path) as file:
                for row in pieces_of(file, path, start, stop):
                    held.append(row)
                    if len(held) == 4096:
                        yield _rows(held)
                        held = []
            yield _rows(held)


def _stitched(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Records of a file that ends of ranges cut."""
    out, now = [], None
    for p in sorted(table.to_pylist(), key=lambda p: p["start"]):
        runs = [(r["off"], r["n"], r["bases"], r["size"]) for r in p["runs"]]
        if p["name"] is not None:
            if now:
                out.append(_indexed(*now, p["path"]))
            now = (p["name"], p["offset"], runs)
        elif now:
            for r in runs:
                _add(now[2], r)
        elif any(r[2] for r in runs):
            raise ValueError(f"{p['path']} doesn't begin with a header")
    if now:
        out.append(_indexed(*now, table.column("path")[0].as_py()))
    return pa.Table.from_batches([_rows([(*r, None, None) for r in out])])


def index_of(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Index of plain FASTA files: path, name (up to the first blank), length, offset of the first base, line_bases, line_bytes. Lines of a record that don't have one length, a file that doesn't begin with a header, and a compressed one raise an error. Blank lines may stand around a record's lines."""
    told = kept(ranges(spark, path, size).mapInArrow(_scanned, _DDL), "fai")
    cut = told.where("runs is not null").groupBy("path").applyInArrow(_stitched, _DDL)
    return told.where("runs is null").unionByName(cut).drop("start", "runs")


def write_fai(index: DataFrame, path: str, to: str) -> None:
    """The index of one file in the usual form, a line for each record in the file's order. Rows go through the driver a partition at a time."""
    store, inner = located(to)
    with store.open_output_stream(inner) as out:
        for r in index.where(F.col("path") == named(path)).orderBy("offset").toLocalIterator():
            out.write("\t".join(map(str, (r.name, r.length, r.offset, r.line_bases, r.line_bytes))).encode() + b"\n")


def read_fai(spark: SparkSession, fai: str, path: str) -> DataFrame:
    """An index as index_of gives it, of the file at `path`."""
    return spark.read.csv(fai, sep="\t", schema=FAI, quote="").select(F.lit(named(path)).alias("path"), "*")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        file = None
        for r in rows:
            if file is None or file.path != r["path"]:
                if file is not None:
                    file.file.close()
                file = Ranged(r["path"], 1)
            seq = b"".join(file.bytes(r["lo"], r["hi"] - r["lo"]).split())
            if len(seq) != r["size"] or b">" in seq:
                raise ValueError(f"{r['path']} isn't the file that was indexed, at byte {r['lo']}")
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c]]) for c in ("name", "begin", "end", "start")), pa.array([seq.upper().decode("ascii")])], ["name", "begin", "end", "start", "seq"])
        if file is not None:
            file.file.close()


def pieces(index: DataFrame, regions: DataFrame, size: int = PIECE) -> DataFrame:
    """Bases of regions (name, begin, end: 0-based, half open, clamped to the record) by pieces: name, begin, end, start, seq in upper case. Only the regions' bytes are read. Regions of unknown names are left out; of a name that occurs in several files all are told."""
    c = F.col
    place = lambda x: c("offset") + F.expr(f"({x} div line_bases) * line_bytes + {x} % line_bases")
    asked = regions.select("name", c("begin").cast("long"), c("end").cast("long")).distinct()
    met = asked.join(index, "name").withColumns({"_from": F.least(F.greatest("begin", F.lit(0)), "length"), "_to": F.greatest(F.least("end", "length"), F.lit(0))})
    starts = F.when(c("_to") > c("_from"), F.sequence("_from", c("_to") - 1, F.lit(size).cast("long"))).otherwise(F.array("_from"))
    cut = met.withColumn("start", F.explode(starts)).withColumn("stop", F.greatest("start", F.least(c("start") + size, "_to")))
    some = c("stop") > c("start")
    spans = cut.select("path", "name", "begin", "end", "start", F.when(some, place("start")).otherwise(0).alias("lo"), F.when(some, place("(stop - 1)") + 1).otherwise(0).alias("hi"), (c("stop") - c("start")).alias("size"))
    return spans.repartition("path", "start", "name").mapInArrow(_read, "name string, begin long, end long, start long, seq string")


def fetch(index: DataFrame, regions: DataFrame) -> DataFrame:
    """One row for each region: name, begin, end, seq. A region must fit in memory, as its row does; pieces() has no such bound."""
    parts = pieces(index, regions).groupBy("name", "begin", "end").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"))
    return parts.select("name", "begin", "end", F.array_join("p.seq", "").alias("seq"))
