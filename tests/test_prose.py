"""Texts are recoded by the task that looks for seeds in them, in slices of bounded size."""

import pyarrow as pa
import pytest

from strandloom.config import SearchConf
from strandloom.operators import contigs, search
from strandloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["shard_min_merge", "bisulfite_join", "hits_by_position", "print_first_k", "pileup_depth"])
def test_bases_do_not_go_from_worker_to_worker(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow _recoded" not in plan


def test_slices_are_whole_rows_of_bounded_size():
    texts = ["a" * n for n in (3, 0, 9, 2, 2, 2, 30)] + [None]
    batch = pa.RecordBatch.from_pydict({"contig_id": range(8), "seq": texts}).slice(1)
    parts = list(contigs.sliced(iter([batch]), 6))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 6 for p in parts)
    assert all(len(b.column(1)[0].as_py()) == 9 for b in contigs._recoded(iter([batch.slice(1, 1)])))


def test_prose_and_contigs_have_the_same_hits(spark, monkeypatch):
    monkeypatch.setattr(contigs, "SLICE", 50)
    rows = spark.createDataFrame([(1, "The quick brown fox, é jumps over."), (2, ""), (3, None), (4, "a QUICK brown fax jumps over it")], "doc_id long, text string").coalesce(1)
    whole = contigs.from_texts(rows, "doc_id", "text")
    reads = whole.where("contig_id = 1").selectExpr("1L as read_id", "substr(seq, 5, 18) as seq")
    conf = SearchConf(errors=2)
    got, want = (sorted(map(tuple, search.hits(reads, c, conf).collect())) for c in (contigs.prose(rows, "doc_id", "text"), whole))
    assert got == want and len(got) > 1
