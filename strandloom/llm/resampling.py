"""Importance resampling towards a target distribution: hashed word runs, log ratios of their buckets, Gumbel top-k.

A text's words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased; its features are all runs of 1 to `n` of them,
each known by a bucket (CRC-32 of its bytes modulo `buckets`). A bucket's gain is 1000 times the log ratio of its smoothed shares in the
target and in the documents, rounded down; a document's weight is the mean gain of its features, rounded down. With Gumbel noise of a keyed
hash added, the documents with the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Long texts are skew: one text may hold a large part of all words. So texts beyond `CHUNK` bytes are cut at word boundaries into chunks, which are
dealt to all tasks. A chunk owns the features that start in its own words, and carries the next n - 1 words so that they are complete; each
feature is thus counted in one chunk. Counts and sums of gains of chunks are added up by document. No feature leaves its task: a task adds up its counts by bucket,
and the driver has a count for each bucket, `buckets` in all.

Null, empty and wordless texts have no feature: weight 0. A null doc_id hashes as an empty one and comes last among ties; rows that repeat a doc_id count
and are drawn each on its own (with equal scores, in any order). Other columns are ignored. No documents give no rows; no target gives gains against an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.places import numbered
from strandloom.llm.shared import discard, partitions, prepare, table, written

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 10, 20, "2024"
#: Bytes of text in a chunk.
CHUNK = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and makes every other byte that isn't of a word a space.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if _WORD[c] else 0x20 for c in range(256))
_CHUNKS = "doc_id long, key long, chunk long, owned long, body binary"
_FEATURES = "doc_id long, key long, chunk long, words long, buckets binary"


def cut(data: bytes, size: int, n: int) -> Iterator[tuple[int, bytes]]:
    """Chunks of a text: the number of bytes whose words the chunk owns, and these bytes with the next n - 1 words after them."""
    data = data.translate(_PLAIN)
    at, end = 0, len(data)
    while at < end:
        stop = end if at + size >= end else data.find(b" ", at + size)
        stop = end if stop < 0 else stop
        tail = stop
        for _ in range(n - 1):  # over spaces, then over a word
            while tail < end and data[tail] == 0x20:
                tail += 1
            space = data.find(b" ", tail)
            tail = end if space < 0 else space
        yield stop - at, data[at:tail]
        at = stop


def _chunked(size: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for chunk, (owned, body) in enumerate(cut(batch.column(2)[i].as_buffer().to_pybytes(), size, n)):
                    numbers = [pa.array([x], pa.int64()) for x in (doc_id, key, chunk, owned)]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array([body], pa.binary())], ["doc_id", "key", "chunk", "owned", "body"])

    return run


def features(body: bytes, owned: int | None, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words that `body` owns (all, where `owned` is null), and the buckets of the features that start at these."""
    plain = body.translate(_PLAIN)
    words = plain.split()
    own = len(words) if owned is None or owned >= len(plain) else len(plain[:owned].split())
    runs = [np.fromiter(map(zlib.crc32, islice(words, own)), np.uint32, own)]
    for k in range(2, n + 1):
        m = max(0, min(own, len(words) - k + 1))
        runs.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) for i in range(m)), np.uint32, m))
    return own, np.concatenate(runs) % np.uint32(buckets)


def _bucketed(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, body in zip(batch.column(3).to_pylist(), batch.column(4)):
                found.append(features(body.as_buffer().to_pybytes() if body.is_valid else b"", own, n, buckets))
            arrays = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["doc_id", "key", "chunk", "words", "buckets"])

    return run


def _hashed(texts: DataFrame, n: int, buckets: int, chunk: int, name: str) -> DataFrame:
    """Texts (doc_id, text) to a written table with a row for each short text (chunk is null) and each chunk of a long one."""
    rows = texts.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("body"))
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    none = F.lit(None).cast("long")
    short = rows.where(size <= chunk).select("doc_id", "key", none.alias("chunk"), none.alias("owned"), "body")
    long = rows.where(size > chunk).mapInArrow(_chunked(chunk, n), _CHUNKS)
    dealt = long.repartition(max(1, partitions(texts.sparkSession)))
    return written(short.unionByName(dealt).mapInArrow(_bucketed(n, buckets), _FEATURES), name)


def _numbers(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of binaries side by side, and the number of each row's."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    flat = b"".join(b.as_buffer() for b in column)
    width = np.dtype(kind).itemsize
    return np.frombuffer(flat, kind).astype(np.int64), np.array([len(b.as_buffer()) // width for b in column], np.int64)


def _counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: each task adds up its own, the driver gets a sum for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _gained(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _numbers(batch.column(4), len(gain))
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[flat])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes), pa.array(total[ends] - total[ends - sizes])], ["doc_id", "key", "chunk", "words", "n_features", "gain"])

    return run


def weighted(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """Documents (doc_id, text) against target (text) to a row for each document: doc_id, n_words, n_features and weight."""
    prepare(documents.sparkSession)
    found = _hashed(documents, n, buckets, chunk, "features")
    aim = _hashed(target.select(F.lit(None).alias("doc_id"), "text"), n, buckets, chunk, "target")
    gain = gains(_counts(found, buckets), _counts(aim, buckets))
    discard(aim)
    parts = found.mapInArrow(_gained(gain), "doc_id long, key long, chunk long, words long, n_features long, gain long")
    short = parts.where("chunk is null").select("doc_id", "words", "n_features", "gain")
    # Rows that are equal have equal chunks: sums are a multiple of one row's, and the first chunks count the rows.
    sums = parts.where("chunk is not null").groupBy("doc_id", "key").agg(F.count_if(F.col("chunk") == 0).alias("copies"), *(F.sum(c).alias(c) for c in ("words", "n_features", "gain")))
    long = sums.select("doc_id", *(F.expr(f"{c} div copies").alias(c) for c in ("words", "n_features", "gain")), F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    return short.unionByName(long).select("doc_id", F.col("words").alias("n_words"), "n_features", mean.cast("long").alias("weight"))


def resampled(documents: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, seed: str = SEED, n: int = 1, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """Documents (doc_id, text) with target (text) to a row each: doc_id, n_features, weight, score and rank; rank (from 1) is null for those that aren't among the `share` hundredths of documents of at least `least` words that are drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weighted(documents, target, n, buckets, chunk).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    enough = F.col("n_words") >= least
    placed, _, eligible = numbered(scored, [(~enough).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "drawn", enough)
    drawn = F.when(F.col("place") < share * eligible // 100, F.col("place") + 1)
    discard(scored)
    return placed.select("doc_id", "n_features", "weight", "score", drawn.cast("long").alias("rank"))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: CRC-32 byte by byte, with the table of its reflected polynomial worked out first.
_SQL = f"""WITH steps AS (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i)),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM steps),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS x FROM d),
bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS x FROM benchmark),
words AS (SELECT DISTINCT x FROM (SELECT x FROM dw UNION ALL SELECT x FROM bw)),
bytes AS (SELECT x, list_transform(range(length(hex(x)) // 2), lambda i: CAST('0x' || substr(hex(x), 2 * i + 1, 2) AS BIGINT)) AS b FROM words),
crc AS MATERIALIZED (SELECT x, xor(list_reduce(b, lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM bytes, tab),
s AS (SELECT k, count(*) AS n FROM dw JOIN crc USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bw JOIN crc USING (x) GROUP BY k),
g AS MATERIALIZED (SELECT s.k, floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + 10000)) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS gain FROM s LEFT JOIN t USING (k)),
sums AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM dw JOIN crc USING (x) JOIN g USING (k) GROUP BY doc_id),
w AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight FROM d LEFT JOIN sums USING (doc_id)),
h AS (SELECT *, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM w),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN r END AS rank FROM ranked"""
SQL = {"op13_importance_resampling": _SQL}
QUERIES = {"op13_importance_resampling": op13_importance_resampling}
