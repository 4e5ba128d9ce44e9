import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import resampling
from strandloom.llm.places import numbered


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plainly(docs, target, n=1, buckets=10_000, share=10, least=20):
    """The contract row by row: sorted rows (doc_id, n_features, weight, score, rank)."""
    key = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for x in runs(text, n):
            s[key(x)] += 1
    for text in target:
        for x in runs(text, n):
            t[key(x)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found = runs(text, n)
        weight = sum(gain[key(x)] for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: share * len(able) // 100]
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if not r[4]], key=repr)


TARGET = ["One two three four", None, "", "éé Many words, it's 9000"]


@pytest.mark.parametrize("n, chunk", [(1, 1 << 20), (1, 50), (3, 1 << 20), (3, 40), (2, 1)])
def test_resampling_equals_the_contract_row_by_row(spark, texts, documents, n, chunk):
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TARGET)], "item_id long, text string, weight string")
    found = resampling.resampled(documents, target, share=40, n=n, chunk=chunk).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plainly(list(texts.items()), TARGET, n, share=40)


def test_chunks_own_each_feature_once():
    text = "  aa bb\tCC dd  ee-ff g " * 20 + "tail"
    for n in (1, 2, 4):
        whole = np.sort(resampling.features(text.encode(), None, n, 1 << 20)[1])
        for size in (1, 2, 7, 50, 10_000):
            parts = [resampling.features(body, owned, n, 1 << 20) for owned, body in resampling.cut(text.encode(), size, n)]
            assert np.array_equal(np.sort(np.concatenate([p[1] for p in parts])), whole)
            assert sum(p[0] for p in parts) == len(words(text))


def test_null_and_repeated_rows_are_drawn_each(spark):
    long = "alpha beta gamma " * 30
    docs = [(1, long), (1, long), (1, long), (None, long), (None, None), (2, "x " * 25), (3, " "), (4, None)] + [(i, f"w{i} " * 21) for i in range(5, 15)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([("alpha beta",)], "text string")
    for chunk in (1 << 20, 64):
        found = sorted((tuple(r) for r in resampling.resampled(df, target, share=50, chunk=chunk).collect()), key=repr)
        assert found == plainly(docs, ["alpha beta"], share=50)


def test_a_text_of_many_megabytes_among_short_ones(spark):
    """A text of 24 MB, and one word of 3 MB, are chunks of their own; all words count."""
    docs = [(1, "many words here " * 1_500_000), (2, "z" * 3_000_000), (3, "short text of few words")]
    found = {r.doc_id: r for r in resampling.weighted(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("many",)], "text string")).collect()}
    assert [found[i].n_features for i in (1, 2, 3)] == [4_500_000, 1, 5]


def test_empty_tables(spark, nothing, documents):
    assert resampling.resampled(nothing, documents).count() == 0
    assert resampling.resampled(documents, nothing.select("text")).count() == documents.count()


def test_places_are_the_global_order_for_equal_rows_too(spark):
    df = spark.range(5000).selectExpr("case when id % 3 = 0 then 7 else id % 100 end as x", "id")
    found, n, seven = numbered(df, [F.col("x").desc()], "places", F.col("x") == 7)
    rows = sorted(found.collect(), key=lambda r: r.place)
    assert n == 5000 and [r.place for r in rows] == list(range(5000)) and seven == sum(r.x == 7 for r in rows)
    assert [r.x for r in rows] == sorted((r.x for r in rows), reverse=True) and len({r.id for r in rows}) == 5000
