"""Catalogue search, inventory screening and corpus preparation on PySpark."""
