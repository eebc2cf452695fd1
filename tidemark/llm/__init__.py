"""Training-data operators: tokenising, deduplication, filtering, packing, sharding."""
