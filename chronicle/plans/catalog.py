"""All registered queries."""

from chronicle.plans import ingestion, insights, people, reports  # noqa: F401  (they register)
from chronicle.plans.query import QUERIES

__all__ = ["QUERIES"]
