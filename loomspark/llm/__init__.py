"""Training-data operators: packing, deduplication, token accounting, mixing, search, scans.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
