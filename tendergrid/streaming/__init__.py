"""Continuous ingestion of landing pages."""
