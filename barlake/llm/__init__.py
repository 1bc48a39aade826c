"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_<name>`` queries live in :mod:`barlake.llm.queries`.
"""
