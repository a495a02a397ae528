"""Structured Streaming jobs: incremental pages, running counters, lifecycle."""
