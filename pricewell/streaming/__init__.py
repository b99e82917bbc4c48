"""Incremental form of the raw-record ingest."""
