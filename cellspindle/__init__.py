"""Spark-native operators for single-cell sequencing tables and the data around them."""

__version__ = "0.1.0"
