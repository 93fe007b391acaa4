"""Incremental ingestion of appended run logs with Structured Streaming."""
