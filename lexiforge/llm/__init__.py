"""Training-data operators: sharding, deduplication, scoring, search, packing, tokenising.

Nothing else in the library imports this subpackage.
"""
