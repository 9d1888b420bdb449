"""Event-stream analytics on Spark: routing, deduplication, drift, incremental runs."""

__version__ = "0.1.0"
