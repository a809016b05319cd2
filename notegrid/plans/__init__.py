"""Registered queries over the given tables."""

import notegrid.plans.records  # noqa: F401  (registers its queries)
from notegrid.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
