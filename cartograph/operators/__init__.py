"""Operators over the graph tables: extraction, resolution, lookup, traversal, analytics."""
