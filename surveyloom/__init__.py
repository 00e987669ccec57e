"""Distributed operators for coded survey tables on Spark DataFrames."""

__version__ = "0.1.0"
