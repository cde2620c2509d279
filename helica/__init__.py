"""Genomic and text data processing as Spark DataFrames."""

__version__ = "0.1.0"
