"""Audit whole tables of expense and payment documents with Spark DataFrames."""

__version__ = "0.1.0"
