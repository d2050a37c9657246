"""Structured Streaming forms of the monitors and the ingest path."""
