"""BAM: records and files as bytes, written by all tasks, and read in splits of any size.

A file is a chain of compressed blocks, and records lie in the bytes of these without regard to where blocks end. A split is what Spark's text source gives for a range of bytes when the mark that
begins a block stands for the end of a line, so files of any store and size are read by many tasks. Within a split

* a block is whole when its own size, its checksum and its length agree; the mark may also occur inside a block, then what follows is put back,
* the first record is guessed: the first place from which several records follow each other, names, operations and tags all in order to their last byte.

What lies before the first block or record and after the last whole one is kept as a piece. The pieces of a file are put together in order: a record that is cut by the end of one split must end exactly where the next
split's first record was guessed. So a wrong guess is never read as data, it ends the query with an error.

Tags are a map of tag to (code, value): the code is the record's own (A c C s S i I f d Z H B), the value is text as in SAM (an array with its kind first), so nothing is changed between reading and writing.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.kept import place as shared_place

COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
KINDS = ["string", "int", "string", "long", "int", "string", "string", "long", "long", "string", "string"]
# What the codes of a BAM record stand for, and how many bytes the numbers of a tag have.
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_FORMS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f", "d": "<d"}
#: An empty block, which marks the end of a file of blocks; the most bytes that are put in a block; what every block begins with.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65280
MARK = b"\x1f\x8b\x08\x04"
#: Records that must follow each other at a guessed place, bytes of records held at once, bytes of records whose fields are objects at once, and rows.
FOLLOW, SLICE, PORTION, ROWS = 4, 1 << 22, 1 << 19, 1 << 10

Tags = dict[str, tuple[str, str]]


# Tags


def _single(x: float) -> str:
    """The shortest text that is the same number in 32 bits."""
    with np.errstate(over="ignore"):
        return next((t for t in (f"{x:.{p}g}" for p in range(1, 10)) if np.float32(t) == np.float32(x)), f"{x:.9g}")


def _shown(code: str, number) -> str:
    return _single(number) if code == "f" else repr(number)


def tags_of(data: bytes) -> Tags:
    """Tags of a record's last bytes, in their order. Bytes that don't end with a whole tag raise an error."""
    found: Tags = {}
    at, end = 0, len(data)
    while at < end:
        tag, code = data[at : at + 2].decode("ascii"), chr(data[at + 2])
        at += 3
        if code in "ZH":
            stop = data.index(b"\0", at)
            value, at = data[at:stop].decode(), stop + 1
        elif code == "A":
            value, at = chr(data[at]), at + 1
        elif code == "B":
            kind, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            value = ",".join([kind, *(_shown(kind, x) for x in struct.unpack_from(f"<{n}{_FORMS[kind][1]}", data, at + 5))])
            at += 5 + n * struct.calcsize(_FORMS[kind])
        else:
            value = _shown(code, struct.unpack_from(_FORMS[code], data, at)[0])
            at += struct.calcsize(_FORMS[code])
        found[tag] = (code, value)
    if at != end:
        raise ValueError("a tag ends beyond its record")
    return found


def tag_bytes(tag: str, code: str, value: str) -> bytes:
    """One tag. A whole number that 32 bits with a sign can't hold is written without one."""
    head = tag.encode("ascii")
    if code in "ZH":
        return head + code.encode() + value.encode() + b"\0"
    if code == "A":
        return head + b"A" + value.encode("latin-1")[:1]
    if code == "B":
        kind, *numbers = value.split(",")
        read = float if kind in "fd" else int
        return head + b"B" + kind.encode() + struct.pack(f"<I{len(numbers)}{_FORMS[kind][1]}", len(numbers), *map(read, numbers))
    number = float(value) if code in "fd" else int(value)
    code = "I" if code == "i" and number >= 1 << 31 else code
    return head + code.encode() + struct.pack(_FORMS[code], number)


def inferred(value: str) -> tuple[str, str]:
    """A code for a value that has none: i for whole numbers as numbers are written, Z for all else."""
    return ("i" if re.fullmatch(r"0|-?[1-9]\d{0,8}", value) else "Z"), value


# Records and blocks to bytes


def bam_header(contigs: list[tuple[str, int]], header: str = "") -> bytes:
    """The beginning of a BAM file, before it is compressed."""
    text = header.encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(contigs))]
    for name, size in contigs:
        out.append(struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", size))
    return b"".join(out)


def packed_bases(seq: str) -> bytes:
    """Bases in four bits each; letters without a code are N."""
    codes = [_BASES.index(c) if c in _BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    return bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))


def unpacked_bases(data: bytes, length: int) -> str:
    return "".join(_BASES[b >> 4] + _BASES[b & 15] for b in data)[:length]


def _bin(begin: int, end: int) -> int:
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >= 0 and begin >> shift == end - 1 >> shift:
            return first + (begin >> shift)
    return 0


def _tag_items(tags) -> list[tuple[str, str, str]]:
    """Tags of a row: maps to (code, value) in their order, maps to text in order of their names."""
    items = list(dict(tags or {}).items())
    if not items or isinstance(items[0][1], str):
        return [(k, *inferred(v)) for k, v in sorted(items)]
    return [(k, v["code"], v["value"]) if isinstance(v, dict) else (k, *v) for k, v in items]


def bam_record(r: dict, tid: dict[str, int]) -> bytes:
    """One record (as of read_bam, or with plain tags)."""
    ops = [(int(n), _OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"] or "")]
    seq = "" if r["seq"] in (None, "*") else r["seq"]
    qual = bytes([255] * len(seq)) if r["qual"] in (None, "*") else bytes(ord(c) - 33 for c in r["qual"])
    tags = b"".join(tag_bytes(*t) for t in _tag_items(r.get("tags")))
    begin = (r["pos"] or 0) - 1
    span = sum(n for n, o in ops if _OPS[o] in "MDN=X") or 1
    own = tid.get(r["rname"], -1)
    name = r["qname"].encode()
    body = struct.pack("<iiIIiiii", own, begin, _bin(begin, begin + span) << 16 | (r["mapq"] or 0) << 8 | len(name) + 1, r["flag"] << 16 | len(ops), len(seq), own if r["rnext"] == "=" else tid.get(r["rnext"], -1), (r["pnext"] or 0) - 1, r["tlen"] or 0)
    body += name + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed_bases(seq) + qual + tags
    return struct.pack("<i", len(body)) + body


def blocks(data: bytes, level: int = 6) -> bytes:
    """Compressed blocks of up to 64 kB, without the one at the end."""
    out = []
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK]
        for each in (level, 0):  # data that doesn't shrink is stored
            deflate = zlib.compressobj(each, zlib.DEFLATED, -15)
            packed = deflate.compress(part) + deflate.flush()
            if len(packed) + 26 <= 65536:
                break
        out.append(MARK + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def bam_bytes(rows: list[dict], contigs: list[tuple[str, int]], header: str = "") -> bytes:
    """A BAM file of some rows (as of read_bam)."""
    tid = {n: i for i, (n, _) in enumerate(contigs)}
    return blocks(bam_header(contigs, header) + b"".join(bam_record(r, tid) for r in rows)) + END_BLOCK


def write_bam(records: DataFrame, contigs: list[tuple[str, int]], path: str, header: str = "", level: int = 6) -> None:
    """BAM as folders: 0_header with one file, 1_records with one for each partition, each written by its task. The files in order of their paths, one after another, are one BAM file; read_bam reads the folder. `level` 0 leaves it uncompressed.

    Each row that is written is a run of whole blocks, with the mark of an end between two, which readers skip within a file; blocks begin at records. The list of contigs is on every executor, as a header is in every file."""
    tid = {n: i for i, (n, _) in enumerate(contigs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = [], []
            size = 0
            for row in (r for lo in range(0, batch.num_rows, ROWS) for r in batch.slice(lo, ROWS).to_pylist()):
                one = bam_record(row, tid)
                if size + len(one) > BLOCK and held:
                    out.append(blocks(b"".join(held), level))
                    held, size = [], 0
                held.append(one)
                size += len(one)
            if held:
                out.append(blocks(b"".join(held), level))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)] if out else [], pa.binary())], ["value"])

    def save(rows: DataFrame, folder: str) -> None:
        # A binary value goes to the file as it is; what stands between lines is the empty block.
        rows.select(F.col("value").cast("string")).write.option("lineSep", END_BLOCK.decode("latin-1")).option("encoding", "ISO-8859-1").text(f"{path}/{folder}")

    spark = records.sparkSession
    save(spark.createDataFrame([(bytearray(blocks(bam_header(contigs, header), level)),)], "value binary").coalesce(1), "0_header")
    save(records.select(*COLUMNS, *(["tags"] if "tags" in records.columns else [])).mapInArrow(run, "value binary"), "1_records")


# Blocks and records from bytes


def block_of(data: bytes) -> bytes | int | None:
    """What a block holds if `data` is exactly one; the number of bytes it needs if `data` is shorter; None if it is no block."""
    if len(data) < 12:
        return 12
    extra = struct.unpack_from("<H", data, 10)[0]
    if len(data) < 12 + extra:
        return 12 + extra
    at, need = 12, 0
    while at + 4 <= 12 + extra:
        kind, size = data[at : at + 2], struct.unpack_from("<H", data, at + 2)[0]
        if kind == b"BC" and size == 2:
            need = struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + size
    if data[:4] != MARK or need < 20 + extra or len(data) > need:
        return None
    if len(data) < need:
        return need
    try:
        found = zlib.decompress(data[12 + extra : -8], -15)
    except zlib.error:
        return None
    return found if struct.unpack("<II", data[-8:]) == (zlib.crc32(found), len(found)) else None


def header_end(data: bytes) -> int | None:
    """Where a header ends, or None if there is more of it than `data`."""
    if len(data) < 12:
        return None
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    if len(data) < at + 4:
        return None
    n = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n):
        if len(data) < at + 4:
            return None
        at += 8 + struct.unpack_from("<i", data, at)[0]
    return at if len(data) >= at else None


def contigs_of(header: bytes) -> list[tuple[str, int]]:
    """Names and lengths of a header's contigs."""
    at = 8 + struct.unpack_from("<i", header, 4)[0]
    out, n = [], struct.unpack_from("<i", header, at)[0]
    at += 4
    for _ in range(n):
        size = struct.unpack_from("<i", header, at)[0]
        out.append((header[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", header, at + 4 + size)[0]))
        at += 8 + size
    return out


def _is_record(data: bytes, at: int) -> bool | None:
    """Whether a record is at `at`; None if all that is there of it could be one."""
    if len(data) < at + 36:
        return None
    size, tid, pos, packed, more, length, mtid, mpos, _ = struct.unpack_from("<iiiIIiiii", data, at)
    n_name, n_cigar = packed & 0xFF, more & 0xFFFF
    fixed = 32 + n_name + 4 * n_cigar + (length + 1) // 2 + length
    if min(tid, pos, mtid, mpos) < -1 or length < 0 or not n_name or size < fixed or (tid < 0 <= mtid and not more >> 16 & 1):
        return False
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or not all(0x21 <= c <= 0x7E for c in name[:-1])):
        return False
    if len(data) < at + 4 + size:
        return None
    if any(b & 15 > 8 for b in data[at + 36 + n_name : at + 36 + n_name + 4 * n_cigar : 4]):
        return False
    try:
        tags_of(data[at + 4 + fixed : at + 4 + size])
    except (ValueError, KeyError, IndexError, struct.error):
        return False
    return True


def first_record(data: bytes, all_there: bool) -> int | None:
    """The first place from which FOLLOW records follow each other, or at least one up to where the data ends in another; None if there is none. Unless the data is `all_there`, a place near its end isn't taken."""
    for at in range(len(data) - 36):
        to, n = at, 0
        while n < FOLLOW:
            is_one = _is_record(data, to)
            if not is_one:
                break
            n, to = n + 1, to + 4 + struct.unpack_from("<i", data, to)[0]
        if n >= FOLLOW or (n and all_there and is_one is None):
            return at
    return None


def _starts(data: bytes, at: int) -> tuple[list[int], int]:
    """Where whole records begin, and where the last of them ends."""
    out, end = [], len(data)
    while at + 4 <= end:
        to = at + 4 + struct.unpack_from("<i", data, at)[0]
        if to > end:
            break
        out.append(at)
        at = to
    return out, at


def _portions(starts: list[int]) -> Iterator[list[int]]:
    """Beginnings of records in runs that are about PORTION bytes long."""
    lo = 0
    for i, at in enumerate(starts):
        if at - starts[lo] >= PORTION:
            yield starts[lo:i]
            lo = i
    if starts:
        yield starts[lo:]


_PAIR = np.array([[ord(_BASES[b >> 4]), ord(_BASES[b & 15])] for b in range(256)], np.uint8)
_TAGS = pa.map_(pa.string(), pa.struct([("code", pa.string()), ("value", pa.string())]))


def _ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ranges side by side, and where each begins among them (with the end of all)."""
    at = np.concatenate([[0], np.cumsum(length)])
    return np.repeat(start - at[:-1], length) + np.arange(at[-1]), at


def _text(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def decoded(data: bytes, starts: list[int], shapes: dict[bytes, str]) -> list[pa.Array]:
    """Columns of records: those of read_bam with contigs as numbers (tid, mtid), all of a slice at once but for CIGARs, which are remembered, and tags."""
    raw, at = np.frombuffer(data, np.uint8), np.array(starts, np.int64)
    f = raw[at[:, None] + np.arange(36)].copy().view("<i4").astype(np.int64).reshape(len(at), 9) if len(at) else np.zeros((0, 9), np.int64)
    size, tid, pos, packed, more, length, mtid, mpos, tlen = f.T
    n_name, mapq, n_cigar, flag = packed & 0xFF, packed >> 8 & 0xFF, more & 0xFFFF, more >> 16 & 0xFFFF
    cigar_at = at + 36 + n_name
    seq_at, half = cigar_at + 4 * n_cigar, (length + 1) // 2
    where, names = _ranges(at + 36, n_name - 1)
    qname = _text(raw[where], names)
    where, held = _ranges(seq_at, half)
    bases, ends = _ranges(2 * held[:-1], length)
    seq = _text(_PAIR[raw[where]].reshape(-1)[bases], ends)
    where, ends = _ranges(seq_at + half, length)
    values = raw[where]
    unknown = length == 0
    unknown[length > 0] = values[ends[:-1][length > 0]] == 255
    qual = _text(np.minimum(values, 93) + np.uint8(33), ends)
    cigar = []
    for a, b in zip(cigar_at.tolist(), seq_at.tolist()):
        key = data[a:b]
        if (text := shapes.get(key)) is None:
            text = shapes[key] = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in struct.unpack(f"<{len(key) // 4}I", key)) or "*"
        cigar.append(text)
    keys, codes, values, ends = [], [], [], [0]
    for a, b in zip((seq_at + half + length).tolist(), (at + 4 + size).tolist()):
        for tag, (code, value) in tags_of(data[a:b]).items():
            keys.append(tag)
            codes.append(code)
            values.append(value)
        ends.append(len(keys))
    pairs = pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(values, pa.string())], ["code", "value"])
    tags = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pairs)
    star = pa.scalar("*")
    number = lambda x, t: pa.array(x, pa.int64()).cast(t)
    return [qname, number(flag, pa.int32()), number(tid, pa.int32()), number(pos + 1, pa.int64()), number(mapq, pa.int32()), pa.array(cigar, pa.string()), number(mtid, pa.int32()), number(mpos + 1, pa.int64()), number(tlen, pa.int64()), pc.if_else(pa.array(length == 0), star, seq), pc.if_else(pa.array(unknown), star, qual), tags]


# Reading in splits

_RECORD = "qname string, flag int, tid int, pos long, mapq int, cigar string, mtid int, pnext long, tlen long, seq string, qual string, tags map<string, struct<code: string, value: string>>"
_PARSED = f"path string, start long, {_RECORD}, header binary, before binary, head binary, found boolean, tail binary, after binary"
_PIECE = ["header", "before", "head", "found", "tail", "after"]
_ARROW = [("qname", pa.string()), ("flag", pa.int32()), ("tid", pa.int32()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mtid", pa.int32()), ("pnext", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", _TAGS)]
_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), *_ARROW, ("header", pa.binary()), ("before", pa.binary()), ("head", pa.binary()), ("found", pa.bool_()), ("tail", pa.binary()), ("after", pa.binary())])


def _batch(path: str, start: int, records: list[pa.Array] | None, piece: dict | None) -> pa.RecordBatch:
    n = len(records[0]) if records else 1
    columns = records or [pa.nulls(1, t) for _, t in _ARROW]
    rest = [pa.nulls(n, _SCHEMA.field(c).type) if piece is None else pa.array([piece[c]], _SCHEMA.field(c).type) for c in _PIECE]
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), *columns, *rest], schema=_SCHEMA)


class _Split:
    """What is read of one split, row by row."""

    def __init__(self, path: str, start: int, shapes: dict[bytes, str]):
        self.path, self.start, self.shapes = path, start, shapes
        self.rows: list[bytes] = []  # from a mark on that may begin a block
        self.in_blocks = self.in_records = start == 0
        self.before: list[bytes] = []
        self.data, self.head, self.header = bytearray(), None, None
        self.first = start == 0

    def take(self, row: bytes) -> Iterator[pa.RecordBatch]:
        if self.first:  # what lies before the first mark of a file
            self.first = False
            if row:
                raise ValueError(f"{self.path} isn't a file of blocks")
            return
        self.rows.append(MARK + row)
        while self.rows:
            found = block_of(b"".join(self.rows))
            if isinstance(found, int):
                return
            if found is None:
                if self.in_blocks:
                    raise ValueError(f"a block of {self.path} is damaged")
                # Not a block, or not one that ends here: what begins at the next mark may be one.
                self.before.append(self.rows.pop(0))
                held, self.rows = self.rows, []
                for each in held:
                    yield from self.take(each[len(MARK) :])
                return
            self.in_blocks, self.rows = True, []
            self.data += found
        if len(self.data) >= SLICE:
            yield from self.records(False)

    def records(self, last: bool) -> Iterator[pa.RecordBatch]:
        at = 0
        if not self.in_records:
            at = first_record(bytes(self.data[: SLICE if not last else None]), last)
            if at is None:
                return
            self.head, self.in_records = bytes(self.data[:at]), True
        elif self.start == 0 and self.header is None:
            if len(self.data) < 4:
                return
            if self.data[:4] == b"BAM\1":
                at = header_end(self.data)
                if at is None:
                    return
            self.header = bytes(self.data[:at])
        data = bytes(self.data[at:])
        starts, end = _starts(data, 0)
        for part in _portions(starts):
            yield _batch(self.path, self.start, decoded(data, part, self.shapes), None)
        self.data = bytearray(data[end:])

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.records(True)
        whole = self.in_records and (self.start > 0 or self.header is not None)
        piece = {"header": self.header, "before": b"".join(self.before), "head": self.head if whole else bytes(self.data), "found": whole, "tail": bytes(self.data) if whole else b"", "after": b"".join(self.rows)}
        yield _batch(self.path, self.start, None, piece | {"head": piece["head"] or b""})


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, shapes = None, {}
    for batch in batches:
        for path, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if now is None or (now.path, now.start) != (path, start):
                if now is not None:
                    yield from now.close()
                now = _Split(path, start, shapes)
            if len(shapes) > 1 << 16:
                shapes.clear()
            yield from now.take(value.as_buffer().to_pybytes())
    if now is not None:
        yield from now.close()


def _stitched(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Records that the ends of splits cut, and the header, from the pieces of one file in order."""
    pieces = sorted(table.to_pylist(), key=lambda p: p["start"])
    path = pieces[0]["path"]
    raw, data, out, header = b"", b"", [], None
    for p in pieces:
        raw += p["before"]
        while raw:
            need = block_of(raw[:12]) if len(raw) >= 12 else 12
            size = need
            while isinstance(need, int) and len(raw) >= need:
                size, need = need, block_of(raw[:need])
            if not isinstance(need, bytes):
                break
            data, raw = data + need, raw[size:]
        if raw and p["found"]:
            raise ValueError(f"a block of {path} is damaged, or the mark of one was taken for another")
        data += p["head"]
        header = p["header"] if p["header"] is not None else header
        if header is None and len(data) >= 4:  # a file of write_bam's records has none
            end = header_end(data) if data[:4] == b"BAM\1" else 0
            if end is not None:
                header, data = data[:end], data[end:]
        if header is not None:
            starts, end = _starts(data, 0)
            out.append(pa.RecordBatch.from_arrays(decoded(data, starts, {}), [n for n, _ in _ARROW]))
            data = data[end:]
        if p["found"]:
            if data:
                raise ValueError(f"records of {path} don't follow each other at byte {p['start']}")
            data, raw = p["tail"], b""
        raw += p["after"]
    if data or raw:
        raise ValueError(f"{path} ends within a record or block")
    rows = pa.Table.from_batches([_batch(path, 0, b.columns, None) for b in out if b.num_rows], schema=_SCHEMA)
    head = _batch(path, 0, None, dict.fromkeys(_PIECE) | {"header": header or b""})
    return pa.concat_tables([rows, pa.Table.from_batches([head])])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM files, of folders of them, or of a folder that write_bam wrote. Files are read in splits of spark.sql.files.maxPartitionBytes and kept as columns in the shared folder.

    The lists of contigs are broadcast, each different one once."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", MARK.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    splits = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary"))
    place = shared_place(spark, "bam")
    splits.mapInArrow(_parsed, _PARSED).write.parquet(f"{place}/splits")
    parsed = spark.read.schema(_PARSED).parquet(f"{place}/splits")
    parsed.where("found is not null").groupBy("path").applyInArrow(_stitched, _PARSED).write.parquet(f"{place}/cut")
    cut = spark.read.schema(_PARSED).parquet(f"{place}/cut")
    origin = F.regexp_replace("path", "/(0_header|1_records)/[^/]*$", "").alias("origin")
    heads = cut.where("length(header) > 0").select(origin, F.xxhash64("header").alias("list"), "header")
    lists = heads.dropDuplicates(["list"]).mapInArrow(_listed, "list long, names array<string>")
    records = parsed.where("found is null").unionByName(cut.where("header is null")).select(origin, *(c for c, _ in _ARROW))
    met = records.join(F.broadcast(heads.select("origin", "list").distinct()), "origin", "left").join(F.broadcast(lists), "list", "left")
    name = lambda c: F.when(F.col(c) >= 0, F.get("names", F.col(c))).otherwise("*")
    rnext = F.when((F.col("mtid") >= 0) & (F.col("mtid") == F.col("tid")), "=").otherwise(name("mtid"))
    return met.withColumns({"rname": name("tid"), "rnext": rnext}).select(*COLUMNS, "tags")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [[n for n, _ in contigs_of(h)] for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.list_(pa.string()))], ["list", "names"])
