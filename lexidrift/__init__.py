"""Corpus-contrast analytics on Spark DataFrames: text patterns, rates, lifts and replication."""
