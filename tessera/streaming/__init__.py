"""Continuous queries, ingestion and rollups."""
