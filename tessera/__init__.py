"""Spark-first matching, messaging and training-data analytics."""
