"""Operators for training-data pipelines: search, joins, tokenising, packing, extraction, deduplication, sharding."""
