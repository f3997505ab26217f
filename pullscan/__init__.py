"""Corpus-scale code-change review on Spark DataFrames."""
