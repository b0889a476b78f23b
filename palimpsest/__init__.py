"""Palimpsest: a Spark-native engine for append-only revision and event logs."""

__version__ = "0.1.0"
