"""Operators of a training-data pipeline: filters, dedup, tokens, packing, search."""
