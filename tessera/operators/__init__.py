"""Queries, tables over time, and results."""
