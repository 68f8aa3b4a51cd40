"""Operators for training-data corpora, each a Spark job over whole tables."""
