"""Training-data operators: extraction, sharding, scanning, deduplication, scoring and token output.

Nothing outside this subpackage imports it.
"""
