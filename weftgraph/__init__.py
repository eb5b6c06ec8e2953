"""Typed dependency-graph analytics on Spark DataFrames."""
