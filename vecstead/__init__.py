"""Embedding-stability analytics on Spark DataFrames."""
