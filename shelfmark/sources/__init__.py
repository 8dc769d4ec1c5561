"""Readers of lists: CSV with row numbers, script and grid JSON, aliases."""
