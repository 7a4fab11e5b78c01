"""Spark-native analytics over trees of related sequences."""
