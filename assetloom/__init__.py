"""Catalogue engine for reusable code assets, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
