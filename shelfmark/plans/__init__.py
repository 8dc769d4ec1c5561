"""Whole queries over the driver's tables, each with its equivalent in SQL."""
