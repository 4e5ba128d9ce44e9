import numpy as np

from strandloom.llm import vectors
from strandloom.llm.components import components


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 16))
    for i in range(100, 180):
        x[i] = x[i % 7] + 0.05 * r.standard_normal(16)
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    data[250] = (250, data[3][1])
    data += [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0, None] * 8), (304, [float("nan")] * 16), (305, [float("inf")] * 16), (306, [1.0, 2.0]), (307, [1.0, 2.0]), (5, data[5][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "'a' AS label", "'b' AS node", "'c' AS weight").repartition(3)
    got = vectors.near_duplicates(df, block=16).collect()
    usable = [(i, np.array(v, float)) for i, v in data if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, label = {}, {}
    for i, v in usable:
        links[i] = 0
        label[i] = i
    for a, (i, v) in enumerate(usable):
        for b, (j, w) in enumerate(usable):
            if a != b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i] += 1
    while True:
        old = dict(label)
        for i, v in usable:
            for j, w in usable:
                if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                    label[i] = label[j] = min(label[i], label[j])
        if old == label:
            break
    links[5] //= 2  # it stands twice, and each counts the other and all else once
    assert len(got) == len(data)
    for row in got:
        assert (row.n_links, row.component_id, row.kept) == (links.get(row.vec_id, 0), label.get(row.vec_id, row.vec_id), label.get(row.vec_id, row.vec_id) == row.vec_id), row
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path_a_star_and_rings(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    ring = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    df = spark.createDataFrame([*path, *star, *ring, (500, 500), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{200 + i: 200 for i in range(9)}}
    assert components(df.limit(0)).count() == 0


def test_vectors_without_an_id_stay_and_link_with_nothing(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (None, None), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found = sorted((tuple(r) for r in vectors.near_duplicates(df).collect()), key=repr)
    assert found == [(1, 1, 1, True), (2, 1, 1, False)] + [(None, 0, None, False)] * 3
