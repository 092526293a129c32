"""Training-data operators: sharding, deduplication, extraction, packing, mixing, quality."""
