"""Operators of a training-data pipeline: extraction, deduplication, sharding,
search, tokenising, mixing and language identification. Nothing outside this
subpackage imports it."""
