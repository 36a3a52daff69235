"""Operators that prepare catalogue text, pages and descriptors as training data."""
