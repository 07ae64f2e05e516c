"""Training-data operators: counts, deduplication, scans, scoring, packing, encoding and search.

Nothing outside this package imports it.
"""
