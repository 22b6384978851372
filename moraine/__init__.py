"""Spark-native analytics for late-interaction retrieval pipelines."""
