"""Operators for building training data: deduplication, search, language, mixing, sharding, scoring and tokens."""
