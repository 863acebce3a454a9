"""All registered queries. Importing the modules registers them."""

from airlume.plans import (  # noqa: F401
    evaluation_queries,
    geometry_queries,
    ingest_queries,
    learning_queries,
)
from airlume.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
