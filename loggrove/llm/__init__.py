"""Operators for preparing large text corpora: deduplication, web archives, filters, mixing."""
