"""Continuous reindexing with Structured Streaming."""
