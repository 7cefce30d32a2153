"""Operators for preparing training text: deduplication, filters, counts, packing, scans and media columns."""
