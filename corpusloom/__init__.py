"""Structured-text corpus and point-set analytics on Spark DataFrames."""
