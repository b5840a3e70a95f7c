"""Spark-first document analytics: sources, text functions, operators, plans and streaming adapters."""

__version__ = "0.1.0"
