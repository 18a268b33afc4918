"""Sequence analytics and kernel learning on Spark DataFrames."""

__version__ = "0.1.0"
