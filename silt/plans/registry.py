"""Where queries and their oracles are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silt.plans import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``oracle`` may name the model's tables as $MEMORY and the like."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = expand(oracle)
        return f

    return register


def expand(text: str) -> str:
    """An oracle with the model's tables and the time put in."""
    for name in ("MEMORY", "WITNESS", "TURN", "SLOT", "TOOL", "ACTION"):
        text = text.replace(f"${name}", getattr(sql, name))
    text = text.replace("$NOW", str(sql.NOW))
    return re.sub(r"(?<!['\w])at(?!['\w])", '"at"', text)  # a reserved word there


def array(words: list[str]) -> str:
    """A DuckDB list of strings."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
