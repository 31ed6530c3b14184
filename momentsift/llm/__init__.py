"""Operators that prepare training text: filters, dedup, scans, packing, counts."""
