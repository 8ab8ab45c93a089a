"""Corpus assembly, retrieval and evaluation on Spark DataFrames."""
