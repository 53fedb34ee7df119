"""Operators that prepare training data: extraction, identification, dedup, scoring, packing, search."""
