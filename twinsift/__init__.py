"""Duplicate analytics on Spark DataFrames."""
