"""All queries of the engine."""

from tidemark.plans import control, features, forecasts, lifecycle, lineage, operations, series, stores, streams  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
