"""Named queries and the plain SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from airlume.sources.derived import DERIVED, GIVEN, uses

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Intermediate results that several oracles start from.
PARTS: dict[str, str] = {}
# Parts that are costly and joined by ranges: their plan must not be merged into another.
SHARED = {"cells", "boxes", "dem_windows", "burned", "lu_windows"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name given tables, derived tables and parts in braces."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_parts(sql)
        return fn

    return register


def _text(name: str) -> str | None:
    return PARTS.get(name) or DERIVED.get(name)


@lru_cache(maxsize=None)
def _needed(name: str) -> tuple[str, ...]:
    text = _text(name)
    if text is None:
        if name not in GIVEN:
            raise KeyError(f"unknown table {name!r}")
        return ()
    order: list[str] = []
    for child in uses(text):
        order += [n for n in _needed(child) if n not in order]
    return (*order, name)


def with_parts(sql: str) -> str:
    """Spell out every derived table and part as a WITH clause."""
    order: list[str] = []
    for child in uses(sql):
        order += [n for n in _needed(child) if n not in order]
    plain = {n: n for n in [*PARTS, *DERIVED, *GIVEN]}
    ctes = ",\n".join(
        f"{n} as {'materialized ' if n in SHARED else ''}({_text(n).format(**plain)})" for n in order
    )
    body = sql.format(**plain)
    return f"with {ctes}\n{body}" if ctes else body


def rd(expression: str, digits: int = 4) -> str:
    """Rounded SQL number without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0e0)"
