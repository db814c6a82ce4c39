"""Training-data operators: extraction, sharding, deduplication, filtering and output."""
