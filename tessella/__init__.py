"""Tessella: a Spark-native engine for tabular analytics, boosting and drift."""

__version__ = "0.1.0"
