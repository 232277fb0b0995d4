"""Scans and sinks of literal tables."""
