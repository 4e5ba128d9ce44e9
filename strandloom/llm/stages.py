"""The stages of the corpus pipeline: functions of (spark, docs, sf_dir). The last one returns pieces, the others rows of documents.

All columns of documents are kept as they are, whatever their names, but for the text where a stage replaces it. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import neardup, packing, pii, toxicity as toxic
from strandloom.llm.shared import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon classifier, trained on the labels, doesn't predict toxic. Null and empty texts have no hit and stay; rows with a null doc_id, and repeated ones, are judged by their text."""
    return toxic.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least doc_id (null after all others), of equal rows any one. Texts without a word are linked with nothing, so all stay."""
    return neardup.unique(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every entity replaced by its surrogate. Null stays null; equal texts stay equal."""
    return pii.surrogates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens. A null text is an empty document; rows with a null or repeated doc_id are packed each."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii_surrogates", pii_surrogates), ("packing", packing_stage)]
