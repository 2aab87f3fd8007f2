"""Siftline: a Spark-first engine for curating and evaluating training data."""

__version__ = "0.1.0"
