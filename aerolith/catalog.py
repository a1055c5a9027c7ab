"""The registered queries of the fleet operators and their DuckDB SQL."""

from __future__ import annotations

from . import queries_cases, queries_feeds, queries_positions, queries_streams  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
