"""Whole pipelines: indexing, and the query catalog over the given tables."""
