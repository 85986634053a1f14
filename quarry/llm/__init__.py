"""Operators for building training corpora: mixing, near-duplicates, secrets, licences, shards,
tokens, repeated passages, nearest neighbours, toxicity and fingerprints."""
