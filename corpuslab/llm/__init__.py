"""Operators for large training corpora: deduplication, filters, extraction, scoring and mixing."""
