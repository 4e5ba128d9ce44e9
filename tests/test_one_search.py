"""Contigs are searched once for a query, and only tiles of contigs that have hits are shuffled."""

import pytest

from strandloom.config import MethylConf
from strandloom.operators import methyl
from strandloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, most", [("set_union_strands", 1), ("screened_reads", 0), ("gapped_search", 1), ("methyl_profile", 1)])
def test_contigs_are_recoded_once(spark, name, most):
    plan = plan_of(spark, name)
    assert plan.count("MapInArrow _recoded") <= most
    assert "MapInArrow _recoded" not in plan or name == "set_union_strands" or "LeftSemi" in plan


def test_cycles_look_at_the_contigs_once(spark, monkeypatch, tmp_path):
    calls, own = [], methyl.observed
    monkeypatch.setattr(methyl, "observed", lambda *args: calls.append(1) or own(*args))
    contigs = spark.createDataFrame([(1, "ACGTCCGTAC" * 4), (2, "ACGTCCGTAC" * 4)], "contig_id long, seq string")
    reads = spark.createDataFrame([(1, "ACGTCCGTACACGTCC"), (2, "ATGTTTGTATATGTTT")], "read_id long, seq string")
    hits = spark.createDataFrame([(1, 1, 0, "+"), (2, 1, 0, "+"), (2, 2, 0, "+")], "read_id long, contig_id long, pos long, strand string")
    done = methyl.resolve(hits, reads, contigs, MethylConf(min_cov=1, max_cov=2), f"file://{tmp_path}").collect()
    assert (1, 1, 0, "+") in {tuple(x) for x in done}
    assert len(calls) == 1
