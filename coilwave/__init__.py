"""Spark-native analytics for controlled-source electromagnetic surveys."""
