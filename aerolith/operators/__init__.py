"""Joins, windows, aggregates, anomaly rules and store consistency as DataFrame functions."""
