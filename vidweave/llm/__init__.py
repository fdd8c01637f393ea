"""Operators for preparing training data: quality, deduplication, tokens, packing and search."""
