"""Spark-first engine for discovery-crawl analytics."""

__version__ = "0.1.0"
