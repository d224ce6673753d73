"""Incremental jobs as Structured Streaming."""
