"""Imports every module that registers queries."""

from strandloom.plans import alignments, records, sequences  # noqa: F401
from strandloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
