"""Readers, writers and the bars derived from given tables."""
