"""Operators for large text collections: deduplication, filtering, tokens and packing."""
