"""Operators for preparing text corpora (deduplication, filtering, tokenising, packing)."""
