"""All named queries over the supplied tables, each paired with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import aggregates, composites, decoders, flows, lookups, matching, raster, sampling, sequences, sheets, small, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
