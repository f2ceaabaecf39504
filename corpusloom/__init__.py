"""Corpus analytics on Spark: DataFrame -> DataFrame operators for building and auditing text corpora."""
