"""Ordered-frame and map analytics on Spark DataFrames."""
