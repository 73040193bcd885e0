"""Incremental ingest and crash-safe incremental answers."""
