"""Gridded point-cloud and space-time sensor analytics on PySpark."""

__version__ = "0.1.0"
