import corpus_pipeline
from strandloom.llm import neardup, pii, registry

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in registry.QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == docs.columns
    toxic, unique, safe = ({r.doc_id: r.text for r in d.collect()} for d in seen[1:])
    assert set(unique) <= set(toxic) and set(safe) == set(unique)
    sets = {i: neardup.word_sets(t or "") for i, t in unique.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert not pairs
    assert all(not ({x[3] for x in pii.find(unique[i] or "")} & {x[3] for x in pii.find(safe[i] or "")}) for i in safe)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(safe)


def test_stages_of_odd_rows_and_of_none(spark):
    """Null ids and texts, repeated rows, clashing columns, and a table without rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(1)).selectExpr("*", "1 AS score", "'x' AS node", "2 AS piece", "'k' AS kind", "3 AS length", "CAST(NULL AS INT) AS own")
    none = odd.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", *[f"`{c}`" for c in odd.columns[2:]])
    both = odd.unionByName(none).unionByName(none)
    for rows in (both, both.where("false")):
        left = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, SF)
            assert left.columns == rows.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
        assert packed.where("doc_id is null").count() == left.where("doc_id is null").count() and {r.doc_id for r in packed.collect()} == {r.doc_id for r in left.collect()}
    assert left.count() == 0


def test_the_guard_is_in_the_entry_alone():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    files = [p for p in [root / "corpus_pipeline.py", *(root / "strandloom").rglob("*.py")] if "ImportError" in p.read_text() or "ModuleNotFoundError" in p.read_text()]
    assert not files
