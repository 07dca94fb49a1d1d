"""Operators of a training-data pipeline: deduplication, scoring, mixing, tokens.

Nothing outside this subpackage imports it.
"""
