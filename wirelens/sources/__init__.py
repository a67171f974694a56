"""Capture and rule sources, and adapters from plain event tables."""
