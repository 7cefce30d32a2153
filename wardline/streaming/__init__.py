"""Incremental jobs with Structured Streaming."""
