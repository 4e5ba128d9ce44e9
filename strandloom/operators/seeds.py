"""Seeds: packed words of a fixed width at every position of a sequence, where they are worked out with array operations."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.contigs import TILE, letters

#: Widest seed that fits a signed 64-bit key.
WIDEST = 31
#: Bases of a block of a stored index.
BLOCK = 1 << 18
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i
#: One bit per base: purines 0, pyrimidines 1. A change that bisulfite makes doesn't change it.
_CODE_TWO = np.full(256, 4, np.uint8)
for _c, _v in zip(b"AGCT", (0, 0, 1, 1)):
    _CODE_TWO[_c] = _v


def packed(seq: bytes, k: int, two: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of width k and whether they are valid (no letter but A, C, G and T). Words of twice a width are two words of it side by side, so there are about log k steps."""
    code = (_CODE_TWO if two else _CODE)[np.frombuffer(seq, np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    bits = 1 if two else 2
    kind = np.int32 if bits * k < 32 else np.int64
    key, width = np.zeros(len(code) + 1, kind), 0
    part, step, left = (code & (1 << bits) - 1).astype(kind), 1, k
    while left:
        if left & 1:
            m = len(code) - width - step + 1
            key = key[:m] << bits * step | part[width : width + m]
            width += step
        left >>= 1
        if left:
            part = part[:-step] << bits * step | part[step:]
            step *= 2
    key = key.astype(np.int64)
    other = code == 4
    if not other.any():
        return key, np.ones(n, bool)
    bad = np.cumsum(np.concatenate(([0], other)))
    return key, bad[k:] == bad[:-k]


def key_of(seq: str, k: int, two: bool = False) -> int | None:
    keys, valid = packed(seq.encode(), k, two)
    return int(keys[0]) if len(keys) and valid[0] else None


def _chunks(batches: Iterator[pa.RecordBatch], k: int, two: bool, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Contig, position and key of valid words, about `most` at a time, whatever the lengths of contigs are."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for contig, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (seq or "").encode("ascii", "replace")
            for lo in range(0, max(0, len(data) - k + 1), most):
                keys, valid = packed(data[lo : lo + most + k - 1], k, two)
                pos = np.flatnonzero(valid)
                held.append((np.full(len(pos), contig, np.int64), pos + lo, keys[pos]))
                size += len(pos)
                if size >= most:
                    yield tuple(np.concatenate(c) for c in zip(*held))
                    held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def seed_counts(contigs: DataFrame, k: int, two: bool = False) -> DataFrame:
    """Numbers of positions by key, as histogram(seed_table(...)), summed where contigs are read: key, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, keys in _chunks(batches, k, two, 1 << 21):
            found, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["key", "n"])

    return contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def seed_table(contigs: DataFrame, k: int, two: bool = False) -> DataFrame:
    """Contigs (contig_id, seq) to (key, contig_id, pos) for every position whose word has no letter but A, C, G and T."""
    if not 1 <= k <= WIDEST:
        raise ValueError(f"a seed has 1 to {WIDEST} bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contigs_, starts, keys in _chunks(batches, k, two):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(contigs_), pa.array(starts)], ["key", "contig_id", "pos"])

    return contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(run, "key long, contig_id long, pos long")


def write_index(seeds: DataFrame, path: str, buckets: int | None = None) -> None:
    """Seeds in buckets of their keys, each sorted: a join on key reads them where they lie and shuffles only the other side, and a reader of some keys opens the row groups that hold them."""
    spark = seeds.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"seeds_{uuid.uuid4().hex}"
    dealt = seeds.select("key", "contig_id", "pos").repartition(n, "key")
    dealt.write.bucketBy(n, "key").sortBy("key", "contig_id", "pos").option("path", path).mode("errorifexists").format("parquet").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay


def read_index(spark, path: str, buckets: int | None = None) -> DataFrame:
    """Seeds that write_index wrote; with the number of buckets they are read as buckets, without it as plain files. The table's name in the catalogue is a hash of the path and the number."""
    if buckets is None:
        return spark.read.parquet(path)
    name = f"seeds_{hashlib.md5(f'{path} {buckets}'.encode()).hexdigest()}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create table if not exists {name} (key bigint, contig_id bigint, pos bigint) using parquet clustered by (key) sorted by (key, contig_id, pos) into {buckets} buckets location '{place}'")
    return spark.table(name)


@dataclass(frozen=True)
class Index:
    """What write_search_index wrote: the seeds' width and alphabet, how long a read may be, and blocks of contigs with their seeds in order. Blocks are read when they are used."""

    k: int
    two: bool
    reach: int
    blocks: DataFrame

    @property
    def contigs(self) -> DataFrame:
        """contig_id and length."""
        return self.blocks.select(F.explode("lengths").alias("l")).select("l.*")


#: Arrays of a block, and the numbers they hold: a contig for each part of the text, where the part begins in it and in the text (with the text's end), and by key the first of its places, and the places.
def arrays(bits: int) -> dict[str, str]:
    return {"contigs": "<i8", "begins": "<i8", "offsets": "<i8", "keys": "<u4" if bits <= 32 else "<i8", "firsts": "<i4", "places": "<i4"}


_BLOCKS = f"{', '.join(f'{c} binary' for c in arrays(0))}, text binary, lengths array<struct<contig_id: bigint, length: bigint>>"


def block(text: np.ndarray, offsets: np.ndarray, own: np.ndarray, k: int, two: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, the first place of each (and their number), and the places in the text in order of key and place. Part i of the text begins at offsets[i]; words that begin in own[i, 0] .. own[i, 1] count, if they end within it."""
    keys, valid = packed(text, k, two)
    ends = np.maximum(np.minimum(own[:, 1], offsets[1:] - k + 1), own[:, 0])
    inside = np.zeros(len(text) + 1, np.int32)
    np.add.at(inside, own[:, 0], 1)
    np.add.at(inside, ends, -1)
    places = np.flatnonzero(valid & (np.cumsum(inside[: len(valid)]) > 0))
    shift = max(1, len(text).bit_length())
    if k * (1 if two else 2) + shift <= 63:  # sorted as one number
        both = keys[places] << shift | places
        both.sort()
        key, places = both >> shift, both & (1 << shift) - 1
    else:
        order = np.argsort(keys[places], kind="stable")
        key, places = keys[places][order], places[order]
    firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    return key[firsts], np.append(firsts, len(key)), places


def _blocks(k: int, two: bool, reach: int, size: int, tile: int):
    around, kinds = max(reach, k), arrays(k * (1 if two else 2))

    def row(parts: list[tuple], lengths: list[tuple]) -> pa.RecordBatch:
        text = np.concatenate([x for *_, x in parts])
        offsets = np.concatenate(([0], np.cumsum([len(x) for *_, x in parts])))
        own = np.array([(first, last) for _, _, first, last, _ in parts], np.int64) + offsets[:-1, None]
        keys, firsts, places = block(text, offsets, own, k, two)
        found = {"contigs": [p[0] for p in parts], "begins": [p[1] for p in parts], "offsets": offsets, "keys": keys, "firsts": firsts, "places": places}
        columns = [pa.array([np.asarray(found[c]).astype(kind).tobytes()], pa.binary()) for c, kind in kinds.items()]
        told = pa.array([[{"contig_id": c, "length": n} for c, n in lengths]], pa.list_(pa.struct([("contig_id", pa.int64()), ("length", pa.int64())])))
        return pa.RecordBatch.from_arrays([*columns, pa.array([text.tobytes()], pa.binary()), told], [*kinds, "text", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lengths, held = [], [], 0
        for batch in batches:
            data, ends = letters(batch.column(1))
            if len(data) and data.max() > 127:
                data, ends = letters(pa.array([(x or "").encode("ascii", "replace").decode() for x in batch.column(1).to_pylist()], pa.string()))
            for contig, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                lengths.append((contig, b - a))
                for lo in range(0, b - a, tile):
                    begin, hi = max(0, lo - around), min(b - a, lo + tile)
                    part = data[a + begin : min(b, a + hi + around)].copy()
                    parts.append((contig, begin, lo - begin, hi - begin, part))
                    held += len(part)
                    if held >= size:
                        yield row(parts, lengths)
                        parts, lengths, held = [], [], 0
        if parts or lengths:
            yield row(parts or [(0, 0, 0, 0, np.zeros(0, np.uint8))], lengths)

    return run


def write_search_index(contigs: DataFrame, path: str, k: int, two: bool = False, reach: int = 1024, partitions: int | None = None, size: int = BLOCK, tile: int = TILE) -> None:
    """Contigs (contig_id, seq) as an index that search.indexed reads, for reads of up to `reach` bases (gaps included), and one row of parameters.

    Contigs are read once, and nothing is shuffled: each task puts about `size` bases in a block, with their seeds in order of keys. Long contigs are cut into tiles that have `reach` bases of what is before and after. With `partitions` contigs are dealt to so many tasks first."""
    if not 1 <= k <= WIDEST:
        raise ValueError(f"a seed has 1 to {WIDEST} bases")
    rows = contigs.select(F.col("contig_id").cast("long"), "seq")
    dealt = rows.repartition(partitions) if partitions else rows
    # Small row groups, looked at after each row: a writer and a reader hold one at once. Without statistics: a writer would keep the least and greatest value of each column, whole arrays, of all its row groups until it closes the file.
    small = {"parquet.block.size": 1 << 23, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false", "parquet.size.statistics.enabled": "false", "compression": "zstd"}
    dealt.mapInArrow(_blocks(k, two, reach, size, tile), _BLOCKS).write.options(**small).parquet(f"{path}/blocks")
    contigs.sparkSession.createDataFrame([(k, two, reach)], "k int, two boolean, reach int").coalesce(1).write.parquet(f"{path}/info")


def read_search_index(spark, path: str) -> Index:
    info = spark.read.parquet(f"{path}/info").first()
    return Index(info.k, info.two, info.reach, spark.read.parquet(f"{path}/blocks"))


def neighbours(k: int, distance: int, letters: int = 4) -> list[tuple[int, int]]:
    """(mask, changes) of every word of `letters` values that differs from zero in at most `distance` (0 to 2) places: keys xor the mask are the neighbours."""
    bits = (letters - 1).bit_length()
    found = [(0, 0)]
    for d in range(1, min(distance, 2) + 1):
        for places in combinations(range(k), d):
            for values in product(range(1, letters), repeat=d):
                found.append((sum(v << bits * p for v, p in zip(values, places)), d))
    return found


def histogram(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("key").agg(F.count("*").alias("n"))
