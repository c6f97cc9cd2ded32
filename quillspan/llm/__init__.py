"""Training-data operators: deduplication, tokenisation, classification, mixing and search.

Nothing outside this subpackage imports it.
"""
