"""Operators for building training data: deduplication, filtering, tokenising and sharding of text tables."""
