"""Spark-native analytics for models under distribution shift."""
