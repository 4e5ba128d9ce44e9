"""Contig tables: lengths, offsets in one running coordinate, duplicate names, ranges of bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators.kept import kept

#: Bases of a tile.
TILE = 1 << 16
#: Bytes that are recoded together, and bytes of texts that are worked on at once.
BLOCK, SLICE = 1 << 20, 1 << 22


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column in a row, and where each begins (and the last one ends); null is empty."""
    c = column.fill_null("").cast(pa.large_string())
    if not len(c):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(c.buffers()[1], np.int64, len(c) + 1, c.offset * 8)
    return np.frombuffer(c.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


# The base that stands for each byte of lower-case prose, and bytes without one (also all those of letters beyond ASCII).
_BASES = bytes.maketrans(S.LETTERS.encode(), S.BASES_OF_LETTERS.encode())
_OTHER = bytes(sorted({*range(256)} - {*S.LETTERS.encode()}))


def sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about `most` bytes of the second column (of whole rows), so that what is worked out for one is small whatever a batch holds."""
    for batch in batches:
        _, at = letters(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _recoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and lower-case texts to ids and bases, a slice at a time; texts without a base are left out."""
    for batch in sliced(batches, SLICE):
        data, at = letters(batch.column(1))
        raw, ends = data.tobytes(), at.tolist()
        out = [b"".join(raw[i : min(i + BLOCK, hi)].translate(_BASES, _OTHER) for i in range(lo, hi, BLOCK)) for lo, hi in zip(ends, ends[1:])]
        kept_ = np.cumsum([0, *map(len, out)]).astype(np.int64)
        seq = pa.LargeStringArray.from_buffers(len(out), pa.py_buffer(kept_), pa.py_buffer(b"".join(out))).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), seq], ["contig_id", "seq"]).filter(pc.greater(pc.binary_length(seq), 0))


def from_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """A text column recoded to bases, as functions.seq.dna does; empty ones are left out. Texts are put in lower case by Spark and recoded a slice of a batch at a time."""
    return prose(texts, key, text).withColumnRenamed("prose", "seq").mapInArrow(_recoded, "contig_id long, seq string")


def prose(texts: DataFrame, key: str, text: str) -> DataFrame:
    """A text column as contigs that aren't recoded yet (contig_id, prose): the search recodes them where it looks for seeds, so bases don't go from one Python worker to another."""
    return texts.select(F.col(key).cast("long").alias("contig_id"), F.lower(text).alias("prose"))


def with_offsets(contigs: DataFrame) -> DataFrame:
    """Adds length and global_start: contigs in order of contig_id, one place between two.

    Lengths are dealt by ranges of the ids that there are, however far apart these lie, and added up within each; the driver adds up a number for each range. Bases are not part of it."""
    spark = contigs.sparkSession
    sized = contigs.select("contig_id", F.length("seq").cast("long").alias("length"))
    dealt = kept(sized.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "contig_id").withColumn("part", F.spark_partition_id()), "lengths")
    before, total = [], 0
    for r in dealt.groupBy("part").agg(F.sum(F.col("length") + 1).alias("n")).orderBy("part").collect():
        before.append((r.part, total))
        total += r.n
    within = F.coalesce(F.sum(F.col("length") + 1).over(Window.partitionBy("part").orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.withColumn("within", within).join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    return contigs.join(starts.select("contig_id", "length", (F.col("before") + F.col("within")).cast("long").alias("global_start")), "contig_id")


def duplicate_names(contigs: DataFrame, name: str = "name") -> DataFrame:
    return contigs.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def unique_names(contigs: DataFrame, name: str = "name") -> DataFrame:
    """The contigs; the plan fails if a name occurs twice."""
    n = F.count("*").over(Window.partitionBy(name))
    return contigs.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate contig name "), F.col(name)))).otherwise(F.lit(True))).drop("_n")


def fetch(contigs: DataFrame, name: str, begin: int, end: int) -> DataFrame:
    """Bases begin..end (0-based, half open) of a contig, clamped to it."""
    lo = max(0, begin)
    return contigs.where(F.col("name") == name).select("name", F.substring("seq", lo + 1, max(0, end - lo)).alias("seq"))


def write_indexed(contigs: DataFrame, path: str, size: int = TILE, partitions: int | None = None) -> None:
    """Named contigs (name, seq) as tiles in order of name and tile, in columns: a reader of a range opens the row groups of its tiles only."""
    named = contigs.withColumn("contig_id", F.xxhash64("name"))
    cut = tiled(named, 0, 0, size).join(named.select("contig_id", "name", F.length("seq").cast("long").alias("length")), "contig_id").select("name", "tile", "start", "length", "seq")
    dealt = cut.repartitionByRange(partitions, "name", "tile") if partitions else cut.repartitionByRange("name", "tile")
    dealt.sortWithinPartitions("name", "tile").write.option("parquet.block.size", 8 << 20).parquet(path)


def fetch_indexed(spark, path: str, name: str, begin: int, end: int, size: int = TILE) -> DataFrame:
    """fetch() over what write_indexed wrote: name and seq; tiles outside the range are pruned by the file's statistics."""
    lo = max(0, begin)
    tiles = spark.read.parquet(path).where((F.col("name") == name) & F.col("tile").between(lo // size, max(lo, end - 1) // size))
    parts = tiles.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("tile", "seq"))).alias("t"), F.min("start").alias("first"))  # the tiles of one range
    return parts.select("name", F.substr(F.array_join(F.col("t.seq"), ""), (F.lit(lo) - F.col("first") + 1).cast("int"), F.lit(max(0, end - lo))).alias("seq"))


def tiled(contigs: DataFrame, after: int, before: int = 0, size: int = TILE) -> DataFrame:
    """Contigs (contig_id, seq) cut into tiles: contig_id, tile, start and seq, which has `size` bases from tile * size on, `before` more in front and `after` more behind (as far as the contig goes); start is where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            held = 0
            for contig, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for tile in range(-(-len(seq or "") // size)):
                    lo = max(0, tile * size - before)
                    part = seq[lo : (tile + 1) * size + after]
                    for column, value in zip(out, (contig, tile, lo, part)):
                        column.append(value)
                    held += len(part)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["contig_id", "tile", "start", "seq"])
                        out, held = ([], [], [], []), 0
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["contig_id", "tile", "start", "seq"])

    return contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(run, "contig_id long, tile long, start long, seq string")


def of_rows(contigs: DataFrame, rows: DataFrame) -> DataFrame:
    """Contigs that rows name, so that only their tiles are shuffled. Rows are read twice, so they should be a written table."""
    return contigs.join(rows.select("contig_id").distinct(), "contig_id", "left_semi")


def with_parts(rows: DataFrame, tiles: DataFrame, at: Column, length: Column, name: str = "part", size: int = TILE) -> DataFrame:
    """Adds the bases of the contig from `at` (0-based, not negative) on, `length` of them or as many as there are; the tiles must go that far. Rows beyond a contig's end, or of unknown contigs, are left out.

    A row meets one tile, never a whole contig."""
    # Bases are one byte each: bytes are cut at a place at once, text is read up to it.
    cut = tiles.select("contig_id", F.col("tile").alias("_tile"), F.col("start").alias("_start"), F.col("seq").cast("binary").alias("_seq"))
    met = rows.withColumns({"_at": at.cast("long"), "_length": length.cast("int")}).withColumn("_tile", F.floor(F.col("_at") / size)).join(cut, ["contig_id", "_tile"])
    part = F.substr("_seq", (F.col("_at") - F.col("_start") + 1).cast("int"), F.col("_length")).cast("string")
    return met.withColumn(name, part).drop("_at", "_length", "_tile", "_start", "_seq")
