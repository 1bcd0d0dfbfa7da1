"""Incremental accumulation over Structured Streaming."""
