"""Training-data operators: packing, deduplication, privacy, tokens, search, filters, quality.

Nothing outside this subpackage imports it.
"""
