"""Operators for preparing training corpora: mixing, archives, scans, token files, filters, shards, deduplication, search."""
