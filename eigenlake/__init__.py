"""Spectral-shape analytics on Spark DataFrames."""
