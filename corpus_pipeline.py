"""A corpus from documents: toxic ones go, one of each group of near copies stays, personal data is replaced, the rest is packed.

The stages are in strandloom.llm.stages; each reads what its predecessor wrote, and the first three return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.shared import table, written
from strandloom.llm.stages import STAGES

#: SQL can't express a trained classifier, an edit-distance automaton or a tokenizer; the stages are held against plainer versions in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
