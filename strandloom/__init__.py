"""Approximate sequence matching on Spark DataFrames."""

__version__ = "0.1.0"
