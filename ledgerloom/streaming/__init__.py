"""Incremental versions of aggregates for Structured Streaming."""
