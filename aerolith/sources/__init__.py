"""Readers, the partitioned lake, keyed upserts and exports."""
