"""Operators for preparing training text: dedup, filters, sharding, search, formats, archives, mixing, tokens, scores."""
