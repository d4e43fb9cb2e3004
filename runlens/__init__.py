"""Spark-native analytics over reproducible machine-learning benchmark runs."""

__version__ = "0.1.0"
