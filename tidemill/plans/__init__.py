"""Ordered computations that never put one key, or the whole table, into one task."""
