"""Spatial and mesh analytics on Spark DataFrames."""
