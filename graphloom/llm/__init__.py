"""Operators for large training-text corpora. Nothing outside this package imports it."""
