"""Queries over the driver tables and the SQL that each is held against."""

from __future__ import annotations

from granary.plans import documents, graphs, monitoring, search  # noqa: F401  (they register their queries)
from granary.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
