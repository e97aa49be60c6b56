"""Operators for preparing training data: deduplication, filtering, scoring, tokenizing and sharding of documents."""
