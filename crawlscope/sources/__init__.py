"""Readers for driver tables, captured crawl data and export artifacts."""
