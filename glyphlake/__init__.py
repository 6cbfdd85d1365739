"""Spark-native analytics for unsupervised text and symbol sequences."""
