"""Lumenveil: a PySpark-native engine for analysing source code and text at scale."""

__version__ = "0.1.0"
