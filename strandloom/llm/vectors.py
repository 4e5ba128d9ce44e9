"""Near-duplicate vectors by random-hyperplane sign hashing in several tables, exact cosines, and connected components.

A table's code of a vector is the signs of its products with `bits` random directions. The number of bits follows the number of
vectors (two more than its binary logarithm), so buckets of unrelated vectors stay small, and the number of tables follows the bits,
so that two vectors at the threshold share a bucket with a chance of `recall`; nearer ones are found more surely. Equal vectors are one, with a weight.

A bucket is cut into blocks of about `block` vectors by a hash of the id; each pair of blocks is a task's unit of work, one product of two matrices. It returns a
row per vector, never pairs: the weight of those it is linked with, and the least id of its component within the unit. A pair that shares several
tables counts in the first of them only. All members of a bucket are compared; there is no cap.

A vector that is null, empty, zero, or holds a null or a component that isn't finite links with nothing, nor do vectors of different lengths. Rows with a null vec_id link with nothing and have a null component; rows that repeat a vec_id
with equal vectors are copies like any other (n_links counts rows), reported once per row. Other columns, labels too, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.components import components
from strandloom.llm.shared import partitions, prepare, table, written

COSINE, RECALL, BLOCK, SEED = 0.95, 0.995, 1024, 7


def tables_for(bits: int, cosine: float, recall: float) -> int:
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None for those that link with nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, at, null = column.values, column.offsets.to_numpy(), column.is_null().to_pylist()
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    out: list[np.ndarray | None] = []
    for i, missing in enumerate(null):
        v = None if missing else x[at[i] : at[i + 1]]
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    names = ["vec_id", "size", "key_a", "key_b", "vector"]
    for batch in batches:
        rows = _rows(batch.column(1))
        plain = [None if v is None else (v + 0.0).tobytes() for v in rows]
        keys = [(None, None) if p is None else tuple(np.frombuffer(xxhash.xxh3_128_digest(p), np.int64).tolist()) for p in plain]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else len(v) for v in rows], pa.int32()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(plain, pa.binary())], names)


def _coded(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            codes: list = [None] * len(sizes)
            data = batch.column(3).to_pylist()
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, size]).standard_normal((size, tables * bits))
                at = np.flatnonzero(sizes == size)
                x = _unit(np.frombuffer(b"".join(data[i] for i in at), np.float64).reshape(len(at), size))
                signs = (x @ planes[size] > 0).reshape(len(at), tables, bits)
                for i, c in zip(at, (signs * weights).sum(axis=2, dtype=np.uint64).view(np.int64)):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], ["node", "size", "weight", "vector", "codes"])

    return run


def _unit_of_work(ids, weight, x, codes, chunk, own_table, a, b, cosine):
    """Weights of links and component labels of one pair of blocks (a, b) of a bucket."""
    left, right = (np.arange(len(ids)),) * 2 if a == b else (np.flatnonzero(chunk == a), np.flatnonzero(chunk == b))
    linked = x[left] @ x[right].T >= cosine
    if a == b:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    label = np.arange(len(ids))
    i, j = np.nonzero(linked)
    u, v = left[i], right[j]
    while True:  # least label over links, until it stays
        old = label.copy()
        np.minimum.at(label, u, old[v])
        np.minimum.at(label, v, old[u])
        label = label[label]
        if (label == old).all():
            break
    fresh = ~(codes[u, :own_table] == codes[v, :own_table]).any(axis=1) if own_table else np.ones(len(u), bool)
    links = np.bincount(u[fresh], weight[v[fresh]], len(ids))
    if a != b:
        links += np.bincount(v[fresh], weight[u[fresh]], len(ids))
    some = np.zeros(len(ids), bool)
    some[u] = some[v] = True
    least = np.full(len(ids), np.iinfo(np.int64).max)  # labels are positions; the least id of each label stands for it
    np.minimum.at(least, label, ids)
    return ids[some], links[some].astype(np.int64), least[label[some]]


def _compared(cosine: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])

    def work(batch: pa.Table) -> pa.RecordBatch | None:
        t, size, a, b = (batch.column(n)[0].as_py() for n in ("table", "size", "a", "b"))
        x = _unit(np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(batch.num_rows, size))
        codes = np.array(batch.column("codes").combine_chunks().values if batch.num_rows else [], np.int64).reshape(batch.num_rows, -1)
        found = _unit_of_work(batch.column("node").to_numpy(), batch.column("weight").to_numpy().astype(float), x, codes, batch.column("chunk").to_numpy(), t, a, b, cosine)
        return None if found is None else pa.RecordBatch.from_arrays([pa.array(f) for f in found], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            held = got if held is None else pa.concat_tables([held, got])
            keys = np.stack([held.column(n).to_numpy() for n in ("table", "code", "size", "a", "b")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            at = 0
            for cut in cuts.tolist():
                if (out := work(held.slice(at, cut - at).combine_chunks())) is not None:
                    yield out
                at = cut
            held = held.slice(at).combine_chunks()
        if held is not None and held.num_rows and (out := work(held)) is not None:
            yield out

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Vectors (vec_id, embedding) to one row each: vec_id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null")
    keyed = written(rows.mapInArrow(_keyed, "vec_id long, size int, key_a long, key_b long, vector binary"), "keyed")
    key = ["size", "key_a", "key_b"]
    reps = written(keyed.where("size is not null").groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "vectors")
    n = max(2, reps.count())
    bits = min(62, math.ceil(math.log2(n)) + 2)
    tables = tables_for(bits, cosine, recall)
    coded = written(reps.select("node", "size", "weight", "vector").mapInArrow(_coded(bits, tables), "node long, size int, weight long, vector binary, codes array<long>"), "codes")
    entries = coded.select("node", "size", F.posexplode("codes").alias("table", "code"))
    bucket = ["table", "code", "size"]
    buckets = written(entries.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    member = written(entries.join(buckets, bucket), "members").withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
    member = member.withColumn("chunk", F.pmod(F.xxhash64("node", "table"), "chunks").cast("int"))
    spread = member.select("node", *bucket, "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    units = spread.select("node", *bucket, "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    full = units.join(coded.select("node", "weight", "vector", "codes"), "node").select("table", "code", "size", "a", "b", "chunk", "node", "weight", "vector", "codes")
    order = ["table", "code", "size", "a", "b"]
    dealt = full.repartition(max(partitions(spark), 1), *order).sortWithinPartitions(*order)
    found = written(dealt.mapInArrow(_compared(cosine), "node long, links long, label long"), "compared")
    joined = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = written(reps.select(*key, "node", "weight").join(links, "node", "left").join(joined, "node", "left").select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "classes")
    out = keyed.select("vec_id", *key).join(classes, key, "left")
    component = F.coalesce("component_id", "vec_id")
    told = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
    none = F.lit(None).cast("long")
    return told.unionByName(vectors.where("vec_id is null").select(none.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), none.alias("component_id"), F.lit(False).alias("kept")))


def op5_hyperplane_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


_SQL = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT * FROM v WHERE length(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND length(a.e) = length(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = c.vec_id AS kept FROM c LEFT JOIN k ON c.vec_id = k.vec_id
UNION ALL SELECT NULL, 0, NULL, false FROM embeddings WHERE vec_id IS NULL"""
SQL = {"op5_hyperplane_dedup": _SQL}
QUERIES = {"op5_hyperplane_dedup": op5_hyperplane_dedup}
