"""Training-data operators: mixing, deduplication, scoring, formatting and packing.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; its
docstring states the result for nulls, empty texts, ties, repeated rows and empty tables.
"""
