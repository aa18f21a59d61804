"""Structured Streaming forms of the daily jobs."""
