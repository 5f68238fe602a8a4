"""Incremental ingest of landing exports with Structured Streaming."""
