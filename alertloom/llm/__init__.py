"""Operators for preparing training text: extraction, filters, dedup, mixing, packing, scoring and token files."""
