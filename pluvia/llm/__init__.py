"""Operators for large training corpora: deduplication, filters, scans, search and packing."""
