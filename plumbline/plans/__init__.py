"""Runs over a table: analysis, verification, suggestion."""
