"""Operators for training-data corpora: quality, urls, languages, duplicates, toxicity, packing, leaks, secrets,
shards and licences. Nothing else in the library imports this subpackage."""
