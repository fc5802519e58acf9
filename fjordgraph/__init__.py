"""Iterative graph analytics on plain Spark DataFrames."""
