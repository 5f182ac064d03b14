"""Structured Streaming forms (an extension: the reference has no streams)."""
