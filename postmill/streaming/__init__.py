"""Structured Streaming forms of the batch steps."""
