"""Spark-native analytics over payment events, scoring results and documents."""

__version__ = "0.1.0"
