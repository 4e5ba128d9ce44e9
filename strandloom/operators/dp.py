"""Alignments with insertions and deletions: banded scores and their CIGARs, for all candidates of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import SearchConf
from strandloom.operators.contigs import letters
from strandloom.operators.kept import kept
from strandloom.operators.search import CHUNK, FEW, budget, budgeted, candidates, hits, pieces_of
from strandloom.operators.seeds import Index, packed

MATCH, MISMATCH, GAP = 1, -1, -2
_LOW = -(1 << 30)
#: The fewest bases of a piece that a read is looked up by, and the most.
PIECE, WIDEST_PIECE = 6, 12
#: Cells of the tables of one call.
CELLS = 1 << 20
#: Bases of the words by which places are ruled out before they are aligned (shared_words is written for 4).
WORD = 4
#: Places that are compared at once.
PLACES = 4096


def banded(reads: np.ndarray, parts: np.ndarray, band: int, free: np.ndarray | None = None, fixed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best alignment of each whole read (a row of bytes) with a stretch of its part, within `band` of the middle diagonal: score, first column used, and operations (M, I, D, from the end on, 0 after the last).

    A part has 2 * band bases more than the read: base i of the read is on the middle diagonal beside base i + band. Zeros stand for what is beyond a contig, where no alignment goes.
    The start is free within the band, or on the middle diagonal if `fixed`; the end is free. `free` are pairs (strand row, read base, part base) that count as equal: a boolean array of reads, bases and columns isn't made, the pairs are compared row by row.
    Of equal steps the diagonal goes first, then the insertion if it is better than the deletion, else the deletion; of equal ends the first."""
    m, n = reads.shape
    width = 2 * band + 1
    score = np.full((m, width), _LOW, np.int32)
    if fixed:
        score[:, band] = 0
    else:
        score[:] = 0
    came = np.zeros((n + 1, m, width), np.int8)
    came[0] = 3  # the start
    rows = np.arange(m)
    for i in range(1, n + 1):
        own = parts[:, i - 1 : i - 1 + width]  # the base beside read base i on each diagonal
        base = reads[:, i - 1 : i]
        same = own == base
        if free is not None:
            same = same | ((base == free[:, :1]) & (own == free[:, 1:]))
        diagonal = np.where(own != 0, score + np.where(same, MATCH, MISMATCH), _LOW)
        insertion = np.full((m, width), _LOW, np.int32)
        insertion[:, :-1] = score[:, 1:] + GAP
        new, how = np.empty_like(score), came[i]
        before = np.full(m, _LOW, np.int32)
        for d in range(width):
            deletion = np.where(own[:, d] != 0, before + GAP, _LOW)
            best = np.maximum(np.maximum(diagonal[:, d], insertion[:, d]), deletion)
            how[:, d] = np.where(diagonal[:, d] == best, 0, np.where(insertion[:, d] > deletion, 1, 2))
            new[:, d] = before = np.maximum(best, _LOW // 2)
        score = new
    end = score.argmax(axis=1)
    total = score[rows, end]
    ops = np.zeros((m, n + 4 * band + 1), np.uint8)
    i, d = np.full(m, n), end.copy()
    for k in range(ops.shape[1]):
        step = came[i, rows, d]
        open_ = step != 3
        if not open_.any():
            break
        ops[:, k] = np.where(open_, np.frombuffer(b"MID\0", np.uint8)[step], 0)
        i = i - (open_ & (step != 2))
        d = d + (open_ & (step == 1)).astype(int) - (open_ & (step == 2))
        d = np.clip(d, 0, width - 1)
    return total, d, ops


def scores(reads: np.ndarray, parts: np.ndarray, band: int, free: np.ndarray | None = None) -> np.ndarray:
    """What banded() scores with a free start, without the operations: a row of the table at a time, diagonals side by side."""
    m, n = reads.shape
    width = 2 * band + 1
    kind = np.int16 if n < 1 << 12 else np.int32
    low = kind(-(1 << 14) if kind is np.int16 else _LOW // 2)
    step = (np.arange(width) * GAP).astype(kind)[:, None]
    beside, bases = np.ascontiguousarray(parts.T), np.ascontiguousarray(reads.T)
    score = np.zeros((width, m), kind)
    for i in range(n):
        own = beside[i : i + width]
        same = own == bases[i]
        if free is not None:
            same |= (bases[i] == free[:, 0]) & (own == free[:, 1])
        inside = own != 0
        new = np.where(inside, score + np.where(same, kind(MATCH), kind(MISMATCH)), low)
        np.maximum(new[:-1], score[1:] + kind(GAP), out=new[:-1])
        # A deletion comes from any diagonal before: a running maximum once each diagonal's own cost is taken off.
        # Before a contig none goes from one diagonal to the next, but the last of those may be left.
        leave = inside.copy()
        leave[:-1] |= inside[1:]
        deeper = np.maximum.accumulate(np.where(leave, new, low) - step, axis=0) + step
        score = np.maximum(np.where(inside, deeper, new), low)
    return score.max(axis=0)


def shared_words(bases: np.ndarray, beside: np.ndarray, band: int, free: np.ndarray | None = None) -> np.ndarray:
    """How many of each read's words of `WORD` bases stand on some diagonal of the band; reads and parts are columns here."""
    n, m = bases.shape
    found = np.zeros((max(0, n - WORD + 1), m), bool)
    for d in range(2 * band + 1) if len(found) else ():
        own = beside[d : d + n]
        same = own == bases
        if free is not None:
            same |= (bases == free[:, 0]) & (own == free[:, 1])
        two = same[:-1] & same[1:]
        found |= two[:-2] & two[2:]
    return found.sum(axis=0, dtype=np.int32)


def least_shared(n: int, least: np.ndarray) -> np.ndarray:
    """The fewest words that an alignment of n bases with such a score leaves whole: each base that is another, put in or left out costs 2 at least and lies in `WORD` words at most."""
    return n - WORD + 1 - WORD * ((n - least) * MATCH // 2)


def cigar(ops: np.ndarray) -> list[tuple[int, str]]:
    """Runs of a row of operations, from the beginning on."""
    return [(len([*run]), op) for op, run in groupby(ops[ops != 0][::-1].tobytes().decode())]


def _rows(column: pa.Array, which: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes of some strings, which have at least so many, as a row of bytes each."""
    taken = pc.utf8_slice_codeunits(column.take(pa.array(which)), 0, n).cast(pa.large_string())
    if not len(taken):
        return np.zeros((0, n), np.uint8)
    at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
    if at[-1] - at[0] != n * len(taken):  # letters of more than a byte
        return np.frombuffer(b"".join(x.encode("ascii", "replace") for x in taken.to_pylist()), np.uint8).reshape(-1, n)
    return np.frombuffer(taken.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, n)


def _aligned(band: int, bisulfite: bool):
    names = ["score", "shift", "cigar", "mismatches", "indels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, least = batch.column("lead").to_numpy(), batch.column("least").to_numpy()
            lengths, held = (pc.binary_length(batch.column(c)).to_numpy() for c in ("pattern", "part"))
            minus = pc.equal(batch.column("strand"), "-").to_numpy(zero_copy_only=False)
            found: dict[int, tuple] = {}
            for n in np.unique(lengths).tolist():
                all_ = np.flatnonzero(lengths == n)
                most = max(1, CELLS // ((n + 1) * (2 * band + 1)))
                width = n + 2 * band
                for lo in range(0, len(all_), most):
                    which = all_[lo : lo + most]
                    reads = _rows(batch.column("pattern"), which, n)
                    part = np.zeros((len(which), width), np.uint8)
                    whole = (lead[which] == 0) & (held[which] >= width)
                    part[whole] = _rows(batch.column("part"), which[whole], width)
                    for row in np.flatnonzero(~whole).tolist():  # at the ends of contigs
                        text = batch.column("part")[int(which[row])].as_py().encode("ascii", "replace")
                        text = text[: width - lead[which[row]]]
                        part[row, lead[which[row]] : lead[which[row]] + len(text)] = np.frombuffer(text, np.uint8)
                    free = np.where(minus[which, None], np.frombuffer(b"AG", np.uint8), np.frombuffer(b"TC", np.uint8)) if bisulfite else None
                    # Most places are chance: too few of their words are the same, and those of the rest that score too little need no operations.
                    good = np.flatnonzero(shared_words(np.ascontiguousarray(reads.T), np.ascontiguousarray(part.T), band, free) >= least_shared(n, least[which]))
                    good = good[scores(reads[good], part[good], band, None if free is None else free[good]) >= least[which[good]]]
                    which, reads, part, free = which[good], reads[good], part[good], None if free is None else free[good]
                    score, first, ops = banded(reads, part, band, free)
                    kind = [(ops == c).sum(axis=1) for c in b"MID"]
                    # score = matches - mismatches - 2 gaps, and matches + mismatches = M.
                    wrong = (kind[0] + GAP * (kind[1] + kind[2]) - score) // 2
                    for row, i in enumerate(which.tolist()):
                        found[i] = (int(score[row]), int(first[row]) - band, "".join(f"{k}{op}" for k, op in cigar(ops[row])), int(wrong[row]), int(kind[1][row] + kind[2][row]))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            rows = pa.array(sorted(found), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), *(pa.array([found[i][k] for i in rows.to_pylist()], t) for k, t in enumerate(kinds))], [*batch.schema.names, *names])

    return run


def _placed(k: int, band: int, bisulfite: bool, pieces: pa.Table):
    """Contigs to the places of pieces (read_id, strand, pattern, least, key, offset) where enough words of the read are the same: what candidates() tells with a slack of `band`, less most of the chance."""
    names = ["read_id", "strand", "pattern", "least"]
    texts = [x.encode("ascii", "replace") for x in pieces.column("pattern").to_pylist()]
    lengths = np.array([len(x) for x in texts], np.int64)
    minus = pc.equal(pieces.column("strand"), "-").to_numpy()
    key, offset, least = (pieces.column(c).to_numpy() for c in ("key", "offset", "least"))
    groups = []
    for n in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == n)
        which = which[np.argsort(key[which], kind="stable")]
        keys, first = np.unique(key[which], return_index=True)
        groups.append((n, which, keys, np.append(first, len(which)), np.frombuffer(b"".join(texts[i] for i in which), np.uint8).reshape(-1, n).T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = letters(batch.column(1))
            if len(data) and data.max() > 127:
                data, ends = letters(pa.array([(x or "").encode("ascii", "replace").decode() for x in batch.column(1).to_pylist()], pa.string()))
            for lo in range(0, max(0, len(data) - k + 1), CHUNK):
                words, valid = packed(data[lo : lo + CHUNK + k - 1], k, bisulfite)
                for n, which, keys, first, columns in groups:
                    slot = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                    at = np.flatnonzero(valid & (keys[slot] == words))
                    slot, row = slot[at], np.searchsorted(ends, at + lo, "right") - 1
                    whole = at + lo + k <= ends[row + 1]
                    at, slot, row = at[whole] + lo, slot[whole], row[whole]
                    times = first[slot + 1] - first[slot]
                    upto = np.cumsum(times)
                    done = 0
                    while done < len(at):  # about PLACES at once, one position's pieces at least
                        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PLACES, "right")))
                        t = times[done:stop]
                        nth = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                        mine, own = np.repeat(first[slot[done:stop]], t) + nth, np.repeat(row[done:stop], t)
                        piece = which[mine]
                        begin = np.repeat(at[done:stop], t) - offset[piece] - band
                        done = stop
                        in_ = begin >= ends[own] - 2 * band
                        mine, own, piece, begin = mine[in_], own[in_], piece[in_], begin[in_]
                        places = begin + np.arange(n + 2 * band)[:, None]
                        beside = data.take(places, mode="clip")
                        edge = np.flatnonzero((begin < ends[own]) | (begin + n + 2 * band > ends[own + 1]))
                        beside[:, edge] = np.where((places[:, edge] < ends[own[edge]]) | (places[:, edge] >= ends[own[edge] + 1]), 0, beside[:, edge])
                        free = np.where(minus[piece, None], np.frombuffer(b"AG", np.uint8), np.frombuffer(b"TC", np.uint8)) if bisulfite else None
                        good = np.flatnonzero(shared_words(columns.take(mine, axis=1), beside, band, free) >= least_shared(n, least[piece]))
                        if len(good):
                            own, piece, begin = own[good], piece[good], begin[good]
                            start, end = np.maximum(begin, ends[own]), np.minimum(begin + n + 2 * band, ends[own + 1])
                            part = pa.array([data[i:j].tobytes().decode() for i, j in zip(start, end)], pa.string())
                            told = pieces.select(names).take(pa.array(piece)).combine_chunks().to_batches()[0]
                            yield pa.RecordBatch.from_arrays([*told.columns, batch.column(0).take(pa.array(own)), pa.array(begin + band - ends[own]), part, pa.array((start - begin).astype(np.int32))], [*names, "contig_id", "pos", "part", "lead"])

    return run


def indel_search(reads: DataFrame, contigs: DataFrame | None, conf: SearchConf, index: Index | None = None, piece: int = PIECE) -> DataFrame:
    """Reads without an ungapped hit, aligned within a band of indels_max: the best score of each read, with CIGARs, if no alignment with max_errors mismatches and indels_max gap bases has a lower one.

    With e mismatches and indels_max gap bases allowed, one of e + indels_max + 1 disjoint pieces is free of both, so it is found exactly where it stands; from there the alignment may leave
    the piece's diagonal by indels_max to either side, before and after it: start and end are free within that band. So an alignment is found wherever its gaps are, in every read
    of at least `piece` bases (or the index's width) for each piece. Reads are looked up by their own pieces, in groups of one width, so short ones don't shorten others'.
    Shorter reads are cut for as many differences as they have pieces for, and alignments with more may be missed in them: pieces of a few bases would be everywhere."""
    ready = budget(reads, conf)
    ungapped = hits(reads, contigs, conf, index=index)
    left = kept(ready.join(ungapped.select("read_id").distinct(), "read_id", "left_anti"), "ungapped")
    # Pieces are cut for as many differences as the search allows.
    room = F.greatest(F.floor(F.length("seq") / F.lit(index.k if index else piece)).cast("int") - 1, F.col("max_errors"))
    wide = left.withColumn("max_errors", F.least(F.col("max_errors") + conf.indels_max, room))
    band = conf.indels_max
    if contigs is not None:
        # A contig gives about as many places as it has bases, so contigs are dealt to all tasks first, however few files they come from.
        contigs = contigs.select("contig_id", "seq").repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # An inserted base isn't a match either.
    least = (F.length("pattern") + 2 * MISMATCH * budgeted(conf, "pattern") + (GAP - MATCH) * band).cast("int").alias("least")
    # Places are many and nearly all chance: they are aligned where they are found, and only what scores enough is shuffled.
    lead = F.greatest(band - F.col("pos"), F.lit(0)).cast("int").alias("lead")
    columns = ["read_id", "strand", "pattern", "least", "contig_id", "pos", "part", "lead"]
    if index:
        parts = candidates(wide, contigs, index.k, conf.bisulfite, index, band).select("*", least, lead).select(*columns)
    else:
        wide = wide.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(WIDEST_PIECE), F.floor(F.length("seq") / (F.col("max_errors") + 1)))).cast("int"))
        widths = sorted(r.width for r in wide.select("width").distinct().collect()) or [1]  # a row for each width
        found = []
        for k in widths:
            own = wide.where(F.col("width") == k).drop("width")
            pieces = pieces_of(own, k, conf.bisulfite)
            held = pieces.agg(F.sum(F.octet_length("pattern").cast("long") + 64)).first()[0] or 0
            if 0 < held <= FEW:
                table = pieces.select("read_id", "strand", "pattern", least, "key", "offset").toArrow()
                kind = pieces.schema["read_id"].dataType.simpleString()
                ddl = f"read_id {kind}, strand string, pattern string, least int, contig_id long, pos long, part string, lead int"
                found.append(contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(_placed(k, band, conf.bisulfite, table), ddl))
            else:
                found.append(candidates(own, contigs, k, conf.bisulfite, None, band).select("*", least, lead).select(*columns))
        parts = reduce(DataFrame.unionByName, found)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    done = parts.mapInArrow(_aligned(band, conf.bisulfite), schema + ", score int, shift int, cigar string, mismatches int, indels int")
    good = done.select("read_id", "contig_id", (F.col("pos") + F.col("shift")).alias("pos"), "strand", "score", "cigar", "mismatches", "indels")
    # Several anchors may lead to one alignment.
    one = good.dropDuplicates(["read_id", "contig_id", "pos", "strand", "cigar"])
    return one.withColumn("top", F.max("score").over(Window.partitionBy("read_id"))).where("score = top").drop("top")
