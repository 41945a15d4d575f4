"""Biodiversity observation analytics on Spark DataFrames."""
