"""Exact top-k inner products by blocks of rows, pruned by sums of component maxima.

Vectors become whole numbers, floor(scale * x) of each component. They are dealt to blocks of about `block` rows; a block holds the greatest and the least
value of each component (a component is a term, its value the weight) and a forward index, the rows themselves. The sum over a query's components of the greatest
product that the block allows is a bound on every score in it. So that bounds are tight, blocks hold vectors that lie near each other: centres are fitted to a
sample of at most `SAMPLE` rows (least hashes of all rows) and each row goes to the nearest; centres decide only where a row lies, and every row is indexed. A cell of any size is split into
as many blocks as it needs by a hash of the row.

Queries go in batches of neighbours. Each batch first scores a block of its own cell, which gives a k-th score for each query; then all bounds are computed, block
summaries against batches, in groups of `GROUP` summaries, and pairs of batch and block in which no query's bound reaches its k-th score are dropped. The rest are scored in waves,
those with the greatest summed bounds first: within a pair only queries whose bound still reaches their k-th score are scored, and after each wave the k-th scores have
risen and more pairs fall. A bound equal to the k-th score is kept, since ties go to the smaller id. Nothing else is dropped, so results are exact.

Vectors that are null or hold a null or a component that isn't finite take no part, nor do those with a component of 2**31 or more after scaling; vectors of different lengths don't meet, and a
length may be 0 (all scores 0). A query's own row is no candidate, but other rows that repeat its id are; each query row is answered. A null vec_id is no query; as a candidate it comes last among ties.
Scores beyond the range of a long raise an error. Other columns are ignored. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import discard, partitions, prepare, table, written

K, SCALE, EVERY = 5, 256, 50
#: Rows of a block, queries of a batch, block summaries compared with a batch at once, rows that centres are fitted to, and centres at most.
BLOCK, BATCH, GROUP, SAMPLE, CELLS = 2048, 512, 256, 16_384, 512
#: Pairs of each batch that are scored in a wave; the last wave takes all that are left.
WAVES = (1, 3, 12)
_LIMIT = float(1 << 31)
_EXACT = float(1 << 53)


def whole(column: pa.Array, scale: int) -> list[bytes | None]:
    """Vectors as whole numbers of 32 bits, None for those that take no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    missing = column.is_null().to_pylist()
    at, x = column.offsets.to_numpy(), column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        fits = np.abs(x) < _LIMIT
    return [None if gone or not fits[lo:hi].all() else x[lo:hi].astype("<i4").tobytes() for gone, lo, hi in zip(missing, at, at[1:])]


def _rows(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = whole(batch.column(2), scale)
            keep = pa.array([f is not None for f in found], pa.bool_())
            sizes = pa.array([None if f is None else len(f) // 4 for f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(found, pa.binary())], ["row", "vec_id", "size", "v"]).filter(keep)

    return run


def _matrix(parts: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<i4").reshape(len(parts), size).astype(np.float64)


def fitted(sample: list[tuple[int, bytes]], cells: int, rounds: int = 6, seed: int = 11) -> dict[int, np.ndarray]:
    """Centres of the vectors of each length, by a few rounds of means."""
    sizes: dict[int, list[bytes]] = {}
    for size, v in sample:
        sizes.setdefault(size, []).append(v)
    out = {}
    for size, rows in sizes.items():
        n = min(cells * len(rows) // len(sample), len(set(rows)))
        if size and n > 1:
            x = np.unique(_matrix(rows, size), axis=0)
            centre = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
            for _ in range(rounds):
                near = _nearest(x, centre)
                total = np.zeros_like(centre)
                np.add.at(total, near, x)
                n_of = np.bincount(near, minlength=n)
                centre = np.where(n_of[:, None] > 0, total / np.maximum(n_of, 1)[:, None], centre)
            out[size] = centre
    return out


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([((centre * centre).sum(axis=1) - 2 * (x[i : i + 4096] @ centre.T)).argmin(axis=1) for i in range(0, len(x), 4096)])


def _placed(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, data = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            cell = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes).tolist():
                if size in centres:
                    at = np.flatnonzero(sizes == size)
                    cell[at] = _nearest(_matrix([data[i] for i in at], size), centres[size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["row", "vec_id", "size", "v", "cell"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and the greatest value of each component of a block's rows."""
    for batch in batches:
        low, high = [], []
        for size, rows in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            x = np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), size)
            low.append(x.min(axis=0).tobytes())
            high.append(x.max(axis=0).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.binary()), pa.array(high, pa.binary())], [*batch.schema.names, "low", "high"])


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and block the greatest score that a row of the block can have; rounded up where products are too great to be exact."""
    found = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    most = np.maximum(np.abs(low), np.abs(high))
    return found if not found.size or (np.abs(q) @ most.T).max() < _EXACT else found + np.abs(found) * 1e-9 + 1e3 * q.shape[1]


_PAIR = {"batch": pa.string(), "size": pa.int32(), "cell": pa.int32(), "chunk": pa.int32(), "bound": pa.float64(), "who": pa.list_(pa.int32()), "upto": pa.list_(pa.float64())}
_PAIRS = "batch string, size int, cell int, chunk int, bound double, who array<int>, upto array<double>"


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a batch and a block in which some query's bound reaches its k-th score: these queries, their bounds, and the sum of these."""
    for batch in batches:
        out: list[tuple] = []
        for size, key, rows, kth, blocks in zip(*(batch.column(n).to_pylist() for n in ("size", "batch", "q", "kth", "summaries"))):
            have = np.array([-np.inf if x is None else x for x in kth])
            low, high = (_matrix([b[n] for b in blocks], size) for n in ("low", "high"))
            found = bounds(_matrix(rows, size), low, high)
            reach = found >= have[:, None]
            total = np.where(reach, found, 0).sum(axis=0).tolist()
            for j in np.flatnonzero(reach.any(axis=0)).tolist():
                who = np.flatnonzero(reach[:, j])
                out.append((key, size, blocks[j]["cell"], blocks[j]["chunk"], total[j], who, found[who, j]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(_PAIR.values())], list(_PAIR))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < _EXACT:
        return (q @ x.T).astype(np.int64)
    found = np.array(q.astype(np.int64).astype(object) @ x.astype(np.int64).T.astype(object))
    if (abs(found) > np.iinfo(np.int64).max).any():
        raise ValueError("a score is beyond the range of a long")
    return found.astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest allowed scores of each row, ties to smaller columns."""
    least = np.iinfo(np.int64).min
    s = np.where(allowed, scores, least)
    if s.shape[1] > k:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        allowed = allowed & (s >= edge[:, None])
    r, c = np.nonzero(allowed)
    order = np.lexsort((c, -s[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(s)))
    top = np.arange(len(r)) - first[r] < k
    return r[top], c[top]


def _scored(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda n: batch.column(batch.schema.get_field_index(n))[i].as_py()  # noqa: B023, E731
                size, key, q, own = get("size"), get("batch"), _matrix(get("q"), get("size")), np.array(get("own"))
                kth = np.array([-np.inf if x is None else x for x in get("kth")])
                reach = np.arange(len(q)) if get("who") is None else np.array(get("who"))[np.array(get("upto")) >= kth[get("who")]]
                x, ids, rows = _matrix(get("v"), size), get("ids"), np.array(get("rows"))
                scores = products(q[reach], x)
                r, c = best(scores, (scores >= kth[reach][:, None]) & (own[reach][:, None] != rows[None, :]), k)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(r), pa.string()), pa.array(own[reach][r], pa.int64()), pa.array([ids[j] for j in c.tolist()], pa.int64()), pa.array(rows[c], pa.int64()), pa.array(scores[r, c], pa.int64())], ["batch", "own", "vec_id", "row", "score"])

    return run


_FOUND = "batch string, own long, vec_id long, row long, score long"


@contextmanager
def _few(spark, rows: int):
    """Arrow batches of at most `rows` rows: a row here has a whole block or batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_UNIT = ["size", "cell", "chunk"]


def _waves(blocks: DataFrame, heads: DataFrame, k: int, group: int, waves: tuple[int, ...]) -> DataFrame:
    """The k best rows of each query: a block of its own cell first, then blocks by their bounds, in waves."""
    spark = blocks.sparkSession

    def scored(pairs: DataFrame, state: DataFrame) -> DataFrame:
        units = pairs.select("batch", *_UNIT, "who", "upto").join(state.select("batch", "own", "q", "kth"), "batch").join(blocks.select(*_UNIT, "ids", "v", "rows"), _UNIT)
        return units.repartition(max(1, partitions(spark)), "batch", "cell", "chunk").mapInArrow(_scored(k), _FOUND)

    def merged(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("batch", "own").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
        return written(found.withColumn("place", place).where(F.col("place") <= k), "best")

    def told(top: DataFrame) -> DataFrame:
        """Batches with the k-th score of each query so far."""
        kth = top.where(F.col("place") == k).groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("own", "score"))).alias("known"))
        return heads.join(kth, "batch", "left").withColumn("kth", F.transform("own", lambda o: F.try_element_at(F.col("known"), o))).drop("known")

    nothing = heads.withColumn("kth", F.transform("own", lambda o: F.lit(None).cast("long")))
    first = heads.select("batch", *_UNIT)
    top = merged(scored(first.withColumn("who", F.lit(None).cast("array<int>")).withColumn("upto", F.lit(None).cast("array<double>")), nothing))
    groups = blocks.select(*_UNIT, "low", "high").join(blocks.groupBy("size").agg(F.ceil(F.count("*") / group).cast("int").alias("groups")), "size")
    groups = groups.groupBy("size", "groups", F.pmod(F.xxhash64("cell", "chunk"), F.col("groups")).cast("int").alias("group"))
    groups = written(groups.agg(F.collect_list(F.struct("cell", "chunk", "low", "high")).alias("summaries")), "groups")
    many = groups.select("size", "groups").distinct()
    grid = told(top).select("batch", "size", "q", "kth").join(many, "size").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).join(groups.drop("groups"), ["size", "group"])
    grid = grid.select("size", "batch", "q", "kth", "summaries").repartition(max(1, partitions(spark)))
    left = written(grid.mapInArrow(_bounded, _PAIRS).join(first, ["batch", *_UNIT], "left_anti"), "pairs")
    discard(groups)
    order = F.row_number().over(Window.partitionBy("batch").orderBy(F.col("bound").desc(), "cell", "chunk"))
    for width in (*waves, None):
        state = told(top)
        still = lambda p: F.get("kth", p["who"]).isNull() | (p["upto"] >= F.get("kth", p["who"]))
        met = left.join(state.select("batch", "kth"), "batch").where(F.exists(F.arrays_zip("who", "upto"), still)).drop("kth").withColumn("order", order)
        met = written(met, "met")
        discard(left)
        now = met if width is None else met.where(F.col("order") <= width)
        if not now.limit(1).count():
            break
        before = top
        top = merged(scored(now, state).unionByName(before.drop("place")))
        left = met.where(F.col("order") > width).drop("order") if width is not None else met
        discard(before)
    return top


def search(vectors: DataFrame, query: str | None = None, k: int = K, scale: int = SCALE, block: int = BLOCK, batch: int = BATCH, group: int = GROUP, sample: int = SAMPLE, cells: int = CELLS, waves: tuple[int, ...] = WAVES) -> DataFrame:
    """The k rows of greatest inner product for each row of `vectors` (vec_id, embedding) of which the condition `query` on vec_id holds: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller vec_id, equal ones to any row."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = written(rows.mapInArrow(_rows(scale), "row long, vec_id long, size int, v binary"), "whole")
    n = rows.count()
    some = rows.select("size", "v", F.xxhash64("row", "vec_id").alias("h")).orderBy("h").limit(sample).select("size", "v").collect()  # at most `sample` rows
    centres = fitted([(r.size, bytes(r.v)) for r in some], max(1, min(cells, -(-n // block), len(some))))
    dealt = written(rows.mapInArrow(_placed(centres), "row long, vec_id long, size int, v binary, cell int"), "cells")
    discard(rows)
    cell = ["size", "cell"]
    counts = dealt.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if(F.expr(query or f"vec_id % {EVERY} = 0")).alias("m"))
    split = lambda n, most: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")
    counts = written(counts.select(*cell, split("n", block).alias("chunks"), split("m", batch).alias("batches")), "counts")
    known = dealt.join(counts, cell)
    spread = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    members = F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("without"), "vec_id", "row", "v")))  # about `block` rows
    packed = known.withColumn("chunk", spread("chunks")).groupBy(*_UNIT).agg(members.alias("m")).select(*_UNIT, F.col("m.vec_id").alias("ids"), F.col("m.v").alias("v"), F.col("m.row").alias("rows"))
    with _few(spark, 8):
        blocks = written(packed.select(*_UNIT, "ids", "v", "rows").mapInArrow(_summed, "size int, cell int, chunk int, ids array<long>, v array<binary>, rows array<long>, low binary, high binary"), "blocks")
    asked = known.where(query or f"vec_id % {EVERY} = 0").withColumn("part", spread("batches"))
    name = F.concat_ws("-", "size", "cell", "part").alias("batch")
    heads = asked.groupBy(*cell, "part", "chunks").agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("m"))  # about `batch` rows
    heads = written(heads.select(name, *cell, F.pmod("part", "chunks").alias("chunk"), F.col("m.row").alias("own"), F.col("m.vec_id").alias("asks"), F.col("m.v").alias("q")), "batches")
    discard(dealt)
    with _few(spark, 8):
        top = _waves(blocks, heads, k, group, waves)
    asks = heads.select(F.explode(F.arrays_zip("own", "asks")).alias("x")).select("x.own", F.col("x.asks").alias("query_id"))
    return top.join(asks, "own").select("query_id", F.col("place").alias("rank"), "vec_id", "score")


def op12_block_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


_SQL = """WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.r, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM k WHERE rank <= 5"""
SQL = {"op12_block_topk": _SQL}
QUERIES = {"op12_block_topk": op12_block_topk}
