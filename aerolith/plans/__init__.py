"""Whole jobs: ingest and detection."""
