"""Operators for large text corpora: deduplication, filtering, tokenising, packing."""
