"""Training-data operators: quality, dedup, decontamination, mixing, sharding, token storage."""
