"""Training-data operators: deduplication, filtering, sharding, packing and mixing for text corpora.

Nothing outside this subpackage imports it.
"""
