"""Places where a piece of a read is the same: found, compared and ruled out in tasks, before anything is shuffled."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.config import SearchConf
from strandloom.functions import seq as S
from strandloom.operators import contigs as contigs_
from strandloom.operators import dp, search
from strandloom.operators.seeds import packed


def test_places_are_compared_before_they_are_shuffled(spark):
    """Windows met by chance aren't shuffled: pieces of few reads are broadcast, also where both sides are shuffled the hits are the same."""
    contigs = spark.createDataFrame([(i, "ACGTTGCAAGTC" * i + "N" * (i % 2) + "TTGACCA") for i in range(6)], "contig_id long, seq string")
    reads = spark.createDataFrame([(1, "ACGTTGCAAGTCACGTTGCA"), (2, "GTCTTGACCA")], "read_id long, seq string")
    conf = SearchConf(errors=1)
    found = search.hits(reads, contigs, conf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("BroadcastHashJoin") < plan.index("MapInArrow", plan.index("BroadcastHashJoin"))
    before, search.FEW = search.FEW, 0
    try:
        shuffled = search.hits(reads, contigs, conf).collect()
    finally:
        search.FEW = before
    assert sorted(found.collect()) == sorted(shuffled) and found.count() > 5


def test_recoded_texts_are_those_of_the_column_function(spark, monkeypatch):
    texts = ["", None, "Ab c!", "é", "KKİz", "xyz" * 50, " ", "q"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = rows.select("doc_id", S.dna(F.col("text")).alias("s")).where(F.length("s") > 0).collect()
    monkeypatch.setattr(contigs_, "BLOCK", 7)
    assert sorted(map(tuple, contigs_.from_texts(rows, "doc_id", "text").collect())) == sorted(map(tuple, want))
    batch = pa.RecordBatch.from_pydict({"contig_id": range(8), "seq": [t and t.lower() for t in texts]})
    out = next(contigs_._recoded(iter([batch])))
    assert dict(zip(*(c.to_pylist() for c in out.columns))) == {r.doc_id: r.s for r in want}


def test_indel_places_are_ruled_out_where_they_are_found(spark):
    """Most places that a piece meets by chance don't leave the task that finds them, and none with a good alignment is lost: the same as with both sides shuffled."""
    rng = np.random.default_rng(5)
    text = ["".join(rng.choice(list("ACGT"), 700)) for _ in range(12)]
    reads = [(i, t[100 + i : 126 + i] + "ACG"[: i % 4] + t[126 + i + i % 5 : 158 + i]) for i, t in enumerate(text)] + [(99, text[0][:20] + text[0][23:50]), (98, text[1][-50:-24] + text[1][-21:])]
    reads_ = spark.createDataFrame(reads, "read_id long, seq string")
    contigs = spark.createDataFrame(list(enumerate(text)), "contig_id long, seq string")
    conf = SearchConf(errors=1, indels=True, indels_max=5)
    got = dp.indel_search(reads_, contigs, conf)
    few = dp.FEW
    try:
        dp.FEW = -1
        want = dp.indel_search(reads_, contigs, conf).collect()
    finally:
        dp.FEW = few
    key = lambda rows: sorted((r.read_id, r.contig_id, r.strand, r.score) for r in rows)
    assert key(got.collect()) == key(want) and len({r.read_id for r in want}) > 8
    pieces = pa.table({"read_id": [1], "strand": ["+"], "pattern": [reads[0][1]], "least": pa.array([40], pa.int32()), "key": [int(packed(reads[0][1].encode(), 6)[0][0])], "offset": [0]})
    batch = pa.RecordBatch.from_pydict({"contig_id": [7], "seq": [reads[0][1][:6] + "T" * 90 + text[0]]})
    assert sum(b.num_rows for b in dp._placed(6, 5, False, pieces)(iter([batch]))) == 1
