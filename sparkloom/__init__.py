"""Spark-native corpus retrieval and usage analytics."""
