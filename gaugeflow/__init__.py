"""Spark-native analytics for irregular multi-sensor time series."""

__version__ = "0.1.0"
