"""Spark-native engine for out-of-distribution detection, detector-failure analysis and data preparation."""

__version__ = "0.1.0"
