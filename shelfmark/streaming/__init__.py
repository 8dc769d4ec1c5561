"""Structured Streaming forms of the list's refresh."""
