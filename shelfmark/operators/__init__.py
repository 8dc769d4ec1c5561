"""Relational operators: index, matching, ranking, screening, extraction and snapshots."""
