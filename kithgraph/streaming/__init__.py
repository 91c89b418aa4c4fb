"""Stateful operators for incremental ingest."""
