"""Recursive, set-based analytics on Spark DataFrames."""
