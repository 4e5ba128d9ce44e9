import math
import random

import numpy as np
import pytest

from strandloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string, size string, batch string, row string"


def plainly(rows, k, every=50, scale=256):
    """Scores of each query, best first, with the ids that may stand at each place."""
    ints = [(i, v and [math.floor(scale * x) for x in v] if v is not None and all(x is not None and math.isfinite(x) for x in v) else None) for i, v in rows]
    out = []
    for a, (i, x) in enumerate(ints):
        if x is None or i is None or i % every:
            continue
        found = sorted(((-sum(p * q for p, q in zip(x, y)), j is None, j or 0) for b, (j, y) in enumerate(ints) if b != a and y is not None and len(y) == len(x)))
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(3)
    centre = [[r.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in centre[i % 7]]) for i in range(900)]
    rows += [(1000 + i, rows[350][1]) for i in range(120)]  # equal vectors
    rows += [(2000, None), (2050, []), (2051, []), (2100, [1.0, None] + [0.0] * 4), (2150, [math.nan] * 6), (2200, [math.inf] + [1.0] * 5), (2250, [0.0] * 6), (2300, [1.0, 2.0]), (2301, [-1.0, 2.0])]
    rows += [(None, rows[0][1]), (None, None), (50, rows[50][1]), (50, rows[50][1]), (100, rows[7][1])]  # rows without an id, and that repeat one
    return rows


@pytest.mark.parametrize("settings", [{}, {"block": 16, "batch": 4, "group": 3, "sample": 200, "waves": (1, 2)}, {"block": 64, "batch": 100, "group": 2, "cells": 1, "waves": ()}, {"block": 7, "batch": 1, "k": 1}])
def test_search_equals_all_scores(spark, vectors, settings):
    df = spark.createDataFrame([(*v, "s", "t", "b", "r") for v in vectors], SCHEMA).repartition(3)
    assert told(topk.search(df, **settings)) == plainly(vectors, settings.get("k", 5))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)]
    found = told(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), block=10, batch=3, group=2))
    assert found == plainly(rows, 5)


def test_tables_without_rows_or_queries(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)).count() == 0
    assert told(topk.search(spark.createDataFrame([(50, [1.0])], schema))) == []


def test_large_components_are_exact(spark):
    big = float(2**31 - 1) / 256
    rows = [(0, [big, big, 1.0]), (1, [big, -big, 0.5]), (2, [big, big, -3.0]), (3, [2.0**40, 0.0, 0.0]), (4, [1.0, 2.0, 3.0])]
    found = told(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=1))
    assert found == plainly([r for r in rows if r[0] != 3], 5)


def test_no_score_of_a_block_is_above_its_bound():
    r = np.random.default_rng(1)
    x, q = np.floor(r.standard_normal((40, 9)) * 256), np.floor(r.standard_normal((20, 9)) * 256)
    assert (topk.bounds(q, x.min(axis=0)[None], x.max(axis=0)[None])[:, 0] >= topk.products(q, x).max(axis=1)).all()
