"""Structured Streaming versions of the ingestion jobs and running counts."""
