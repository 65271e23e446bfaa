"""Symbolic time-series analytics on Spark DataFrames."""
