"""The catalogue of queries over the standard tables, with a DuckDB oracle where SQL can express one."""

from __future__ import annotations

from silt.plans import distil_queries, evidence_queries, ranking_queries, text_queries, transcript_queries, upkeep_queries  # noqa: F401  they register themselves
from silt.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
