"""All registered queries."""

from registra.plans import (  # noqa: F401  each module registers its queries
    expressions, figures, graphs, places, records, selection, topics, updates, vectors,
)
from registra.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
