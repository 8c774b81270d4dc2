"""Costbook: construction cost-norm analytics on Spark DataFrames."""
