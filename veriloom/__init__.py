"""Spark-first engine for evidence retrieval over regulation texts and statistical facts."""

__version__ = "0.1.0"
