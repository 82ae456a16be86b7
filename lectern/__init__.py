"""Spark-native analytics for long-form speech text."""
