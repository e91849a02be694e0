"""Operators of a training-data pipeline: counting, sharding, filtering, deduplication, mixing and token files."""
