"""Quarry: content-defined chunking, deduplication and artifact-store analytics on Spark."""

__version__ = "0.1.0"
