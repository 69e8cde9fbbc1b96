"""Spark-native analytics over dependency graphs, change artifacts and text corpora."""
