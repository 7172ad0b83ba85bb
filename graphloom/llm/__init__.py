"""Training-data operators on Spark: scoring, counting, matching, dedup, packing.

Nothing outside this subpackage imports it.
"""
