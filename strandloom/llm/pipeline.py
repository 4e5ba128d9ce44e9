"""The pipeline of corpus_pipeline.py as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
