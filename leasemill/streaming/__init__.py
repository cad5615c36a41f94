"""Arrival-driven ingestion on Structured Streaming."""
