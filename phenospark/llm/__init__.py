"""Operators of a training-data pipeline: mixing, near-duplicates, filtering, tokens, packing, search.

Nothing else in the library imports this subpackage.
"""
