"""Spark-native discovery and checking of invariants in wide snapshot tables."""

__version__ = "0.1.0"
