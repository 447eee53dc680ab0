"""Readers of history tables and metadata, and sinks."""
