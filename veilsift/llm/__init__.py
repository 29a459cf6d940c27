"""Training-data operators: filtering, scoring, deduplication, mixing, packing.

Nothing outside this subpackage imports it.
"""
