"""Corpus and evaluation analytics on Spark: DataFrame in, DataFrame out."""
