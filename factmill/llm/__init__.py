"""Operators for preparing training data: deduplication, quality, packing, search, archives, tokens, language models."""
