"""Queries of this subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(*modules) -> None:
    for m in modules:
        QUERIES.update(m.QUERIES)
        SQL.update(getattr(m, "SQL", {}))


from strandloom.llm import bytebpe, counts, flac, hmm, licenses, neardup, packing, pii, pipeline, prefixes, resampling, topk, toxicity, vectors  # noqa: E402

_add(hmm, neardup, packing, counts, vectors, bytebpe, toxicity, flac, licenses, pii, prefixes, resampling, topk, pipeline)
