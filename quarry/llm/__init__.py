"""Operators of a training-data pipeline: filtering, near-duplicates, tokenising, packing and media columns."""
