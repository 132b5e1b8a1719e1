"""Training-data operators: deduplication, counting, mixing, search, scoring and archives."""
