"""Structured Streaming forms of the writers."""
