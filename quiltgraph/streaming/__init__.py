"""Append ingestion from streams."""
