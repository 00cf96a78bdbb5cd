"""Incremental variant of the article ingest."""
