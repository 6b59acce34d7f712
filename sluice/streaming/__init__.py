"""Structured Streaming forms of folder ingest (STR-1..3)."""
