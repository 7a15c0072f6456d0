"""Spark-native analytics for time-ordered head-to-head match data."""
