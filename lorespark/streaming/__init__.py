"""Structured Streaming forms of ingest and of the run log."""
