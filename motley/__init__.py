"""Spark-native analytics for measuring, deduplicating, selecting and comparing text collections."""

__version__ = "0.1.0"
