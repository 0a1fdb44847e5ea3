"""Incremental upkeep of summaries with Structured Streaming."""
