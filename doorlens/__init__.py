"""Spark-native preparation, evaluation and monitoring of door-state detection data."""

__version__ = "0.1.0"
