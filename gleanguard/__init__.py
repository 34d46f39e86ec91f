"""Spark-native scanning of large text collections for sensitive data."""

__version__ = "0.1.0"
