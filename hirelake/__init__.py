"""Posting-index analytics on Spark: DataFrames in, DataFrames out."""
