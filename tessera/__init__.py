"""Structured-metadata extraction analytics on Spark DataFrames."""
