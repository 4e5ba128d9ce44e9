"""The stateless steps on streams: trimming, and a search against fixed contigs for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.config import SearchConf, TrimConf
from strandloom.operators.search import search
from strandloom.operators.trim import trim


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """A stream of Parquet files of reads."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def trimmed_stream(reads: DataFrame, conf: TrimConf = TrimConf()) -> DataFrame:
    return trim(reads, conf)


def search_stream(reads: DataFrame, contigs: DataFrame, conf: SearchConf, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that searches each micro-batch and hands its hits to `sink` with the number of the batch; a repeated batch has the same number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(search(batch, contigs, conf), number)

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
