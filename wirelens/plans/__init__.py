"""Whole analyses: which operators run over one capture, and their reports."""
