"""Operators for building training corpora: filters, duplicates, packing, mixing, search.

Nothing else in the library imports this package; it may be removed as a whole.
"""
