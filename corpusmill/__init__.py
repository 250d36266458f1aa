"""Corpus audit on Spark: every operator takes DataFrames and gives DataFrames."""
