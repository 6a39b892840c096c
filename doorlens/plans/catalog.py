"""All registered queries."""

from doorlens.plans import catalog_rows, catalog_sets, catalog_time  # noqa: F401
from doorlens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
