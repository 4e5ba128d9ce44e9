"""Documents packed into sequences of a fixed number of tokens by best fit over a histogram of lengths.

Each text is tokenized once, where it is read. Its words (runs between white space, which the tokenizer drops) are cut
where letters, digits and other signs meet, as the tokenizer does, and A-Z lower-cased; words for which that isn't all it
does (contractions, special tokens, other scripts) stay whole. These runs are looked up in a bounded memory of run to ids;
only unknown ones go to the tokenizer. Only documents longer than a sequence are cut. What goes on is a row per piece of
four numbers; texts and ids don't move.

The plan needs the number of pieces of each length only: at most `capacity` rows at the driver. Lengths are placed from the longest
on, each into the open sequences with the least room that is enough, all sequences with the same room at once, as many
pieces in each as fit. A step of the plan gives a run of ranks within a length a run of sequences and an offset. A piece
takes the slot of its rank within its length. Ranks come from counts: the pieces of a length are dealt to blocks by a hash,
numbered within their block, and shifted by the counts of the blocks before, so no length is gathered in one task. Their order doesn't matter, for pieces of a length
are interchangeable.

Null text is empty; an empty document is one token, the end id. A null doc_id is packed too. Rows that repeat a doc_id are
packed each, as rows of their own. Other columns are ignored. An empty table gives no rows. Very long texts give as many pieces as they need.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.recent import Recent
from strandloom.llm.shared import prepare, table, together, written

CAPACITY, END, BLOCK_ROWS = 4096, 1, 100_000
#: Bytes of runs that a Python worker remembers.
RUNS = 176 << 20
#: Runs that go to the tokenizer together.
TOLD = 1 << 15
#: Bytes of text that are looked at together.
SLICE = 4 << 20
#: Kinds of bytes: 0 white space of ASCII, which the tokenizer drops, 1 letters of one or two bytes, 2 digits, 3 other signs, 4 those that leave their word whole.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WHOLE = 4
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC6)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = _WHOLE  # contractions begin with it
_KIND[_SPACE] = 0
#: Pairs of bytes that leave their word whole too: the start of a special token, signs among the letters, letters whose lower case is of ASCII.
_ODD = np.zeros(1 << 16, bool)
_ODD[[int.from_bytes(c.encode()) for c in ("<|", "\xd7", "\xf7", "\u0130", "\u017f")]] = True
#: Words of these characters are their own normal form but for the lower case, and split as _PARTS says: contractions, letters, one digit, other signs.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+")
_PARTS = re.compile("\n|'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\u017e]+|[0-9]|[^\na-z\xdf-\xf6\xf8-\u017e0-9]+")
#: Plain words of one part.
_ONE = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+|[0-9]|[!-&(-/:-@[-`{-~]+")


def _kinds(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes, one kind throughout a word that stays whole, and the bytes with A-Z lower-cased in all other words."""
    kind = _KIND[data]
    low = data | ((data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5))
    first = np.flatnonzero((data[:-1] >= 0xC3) | (data[:-1] == 0x3C))
    odd = first[_ODD[data[first].astype(np.uint16) << 8 | data[first + 1]]]
    stay = np.concatenate((np.flatnonzero(kind == _WHOLE), odd))
    if len(stay):
        inside = kind > 0
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        whole = np.zeros(len(start), bool)
        whole[np.searchsorted(start, stay, "right") - 1] = True
        start, size = start[whole], (end - start)[whole]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        kind[at], low[at] = _WHOLE, data[at]
    return kind, low


class WordIds:
    """Ids of words as little-endian bytes. The tokenizer's own model merges the parts of words; a word that isn't plain goes to the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = dict(zip([*printed, *(b for b in range(256) if b not in printed)], [*map(chr, printed), *(chr(256 + i) for i in range(68))]))
        self.runs = Recent(RUNS)

    def merge(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts, each a word of the model's."""
        tokenize, ids, ends = self.model.tokenize, [], []
        for p in parts:
            ids += [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.shown))]
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return {p: data[lo:hi] for p, lo, hi in zip(parts, [0, *ends], ends)}

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, null as an empty one. Runs of many texts are found, told apart and put together by array operations; Python sees each distinct run of a slice once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if n else np.zeros(0, np.uint8)
        at = at - at[0] if n else at
        row, held, lo = 0, [], 0  # the text that is next, what earlier slices had of it
        while row < n:
            hi = min(len(data), lo + SLICE)
            if hi < len(data):  # a slice ends at a text's end, or else before white space
                ends = int(at[np.searchsorted(at, hi, "right") - 1])
                if ends > lo:
                    hi = ends
                else:
                    gaps = np.flatnonzero(_SPACE[data[hi : at[row + 1]]])
                    hi = hi + int(gaps[0]) if len(gaps) else int(at[row + 1])
            last = int(np.searchsorted(at, hi, "right")) - 1  # texts before it end in this slice
            cuts = np.clip(at[row : min(last, n - 1) + 2], lo, hi) - lo
            ids, ends = self.slice(data[lo:hi], cuts)
            for k in range(row, last):
                yield b"".join([*held, ids[4 * ends[k - row] : 4 * ends[k - row + 1]].tobytes()])
                held = []
            if last < n:
                held.append(ids[4 * ends[last - row] :].tobytes())
            row, lo = last, hi

    def slice(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Ids (as bytes) of texts side by side, and how many of them stand before each cut."""
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        kind, low = _kinds(data, edge)
        inside = kind > 0
        change = (kind[1:] != kind[:-1]) | edge[1:-1]
        start, end = inside.copy(), inside.copy()
        start[1:] &= change
        end[:-1] &= change
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(start):
            return np.zeros(0, np.uint8), [0] * len(cuts)
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        one = pa.LargeListArray.from_arrays([0, len(runs.dictionary)], runs.dictionary)  # runs hold no line feed, so one text of all is cut quickly
        distinct = pc.binary_join(one, pa.scalar(b"\n", pa.large_binary()))[0].as_buffer().to_pybytes().decode().split("\n")
        found = [*map(self.runs.get, distinct)]
        if None in found:
            missing = [w for w, x in zip(distinct, found) if x is None]
            new = {}
            for lo in range(0, len(missing), TOLD):
                new.update(self.told(missing[lo : lo + TOLD]))
            found = [new[w] if x is None else x for w, x in zip(distinct, found)]
            self.runs.keep(new, lambda: {*distinct})
        sizes = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=sizes[1:])
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(sizes), pa.py_buffer(b"".join(found))]).take(runs.indices)
        before = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        return np.frombuffer(ids.buffers()[2], np.uint8, before[-1]), (before[np.searchsorted(start, cuts)] // 4).tolist()

    def told(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words (or runs of them) that aren't known, and of parts of theirs that aren't."""
        one, plain, rest = [], [], []
        for w in words:
            (one if _ONE.fullmatch(w) else plain if _PLAIN.fullmatch(w) and "<|" not in w else rest).append(w)
        low = "\n".join(one).lower().split("\n") if one else []
        flat = _PARTS.findall("\n".join([*plain, ""]).lower())  # a line feed ends each word's parts
        lowered = [(w, p) for w, p in zip(one, low) if w != p]
        others = {*flat, *(p for _, p in lowered)} - {"\n"}
        out = self.merge([*{*one}.difference(w for w, _ in lowered), *self.runs.missing(others).difference(one)])
        ids = [b"" if p == "\n" else out.get(p) or self.runs.get(p, b"") for p in flat]
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
        ends = at[[i for i, p in enumerate(flat) if p == "\n"]].tolist()
        data = b"".join(ids)
        out.update([(w, out.get(p) or self.runs.get(p, b"")) for w, p in lowered])
        out.update(zip(plain, [data[lo:hi] for lo, hi in zip([0, *ends], ends)]))
        out.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False)))
        return out


_held: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, end: int):
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _held.setdefault(path, None) or WordIds(path)
        _held[path] = ids
        for batch in together(batches, SLICE):
            out: list[tuple] = []
            for key, found in zip(batch.column(0).to_pylist(), ids.of(batch.column(1).combine_chunks())):
                found += tail
                whole = zlib.crc32(found)
                if len(found) <= 4 * capacity:
                    out.append((key, whole, 0, 0, len(found) // 4, whole))
                    continue
                for piece, at in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[at : at + 4 * capacity]
                    out.append((key, whole, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(6)], names)

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, last rank + 1, first sequence, pieces per sequence, offset) from counts of lengths."""
    steps, sequences = [], 0
    rooms: list[int] = []  # ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                rooms.insert(bisect_left(rooms, room), room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(i)
            else:
                room, each = capacity, capacity // length
                first, n = sequences, -(-left // each)
                sequences += n
            each = room // length
            full = min(n, left // each)
            for used, per in ((full, each), (1, left - full * each) if full < n and left > full * each else (0, 0)):
                if used and per:
                    steps.append((length, rank, rank + used * per, first, per, capacity - room))
                    add(room - per * length, first, used)
                    first, n, rank, left = first + used, n - used, rank + used * per, left - used * per
            add(room, first, n) if room < capacity else None
    return steps


def _slots(steps: list[tuple], capacity: int):
    table_ = np.array(sorted(steps), np.int64).reshape(-1, 6)
    key = table_[:, 0] << 44 | table_[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            step = table_[np.searchsorted(key, length << 44 | rank, "right") - 1]
            j = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(step[:, 3] + j // step[:, 4]), pa.array(step[:, 5] + j % step[:, 4] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Documents (doc_id, text) to pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = written(docs.mapInArrow(_pieces(path, capacity, end), "doc_id long, row long, piece long, start long, length long, ids_crc32 long"), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    blocks = max(1, sum(counts.values()) // BLOCK_ROWS)
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(max(blocks, 64))).cast("int"))
    sizes = blocked.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("length", "block", F.coalesce("before", F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "row", "start"))
    ranked = blocked.withColumn("local", local).join(before, ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local") - 1).alias("rank"))
    return ranked.mapInArrow(_slots(plan(counts, capacity), capacity), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumn("piece", F.col("piece").cast("int")) if counts else pieces.select("doc_id", F.col("piece").cast("int"), "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
