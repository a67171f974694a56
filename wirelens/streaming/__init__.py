"""Structured Streaming forms of the interval and scan operators."""
