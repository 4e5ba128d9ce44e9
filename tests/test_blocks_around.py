"""What lies around each match of a CIGAR is worked out once for each text of a batch, not by patterns for each record."""

import random

from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.operators import pileup


def test_equal_to_the_column_functions(spark):
    r = random.Random(5)
    texts = ["".join(f"{r.choice([0, 1, 2, 12])}{r.choice('MMMMIDNSHP=X')}" for _ in range(r.randint(1, 9))) for _ in range(500)]
    df = spark.createDataFrame([(t, i % 7) for i, t in enumerate([*texts, "*", "", "none"])], "cigar string, pos long")
    plain = C.blocks(C.neighbourhood(C.operations(F.col("cigar"))), F.lit(0), {"indel": "int", "first": "boolean", "last": "boolean"})
    assert df.where(~plain.eqNullSafe(C.blocks_around(F.col("cigar")))).count() == 0


def test_no_patterns_for_each_record(spark):
    df = spark.createDataFrame([("a", 0, 1, 5, "2M1I2M", "ACGTA")], "qname string, flag int, contig_id long, pos long, cigar string, seq string")
    plan = pileup.columns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "ArrowEvalPython" in plan
