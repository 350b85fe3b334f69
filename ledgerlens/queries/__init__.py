"""Every query on the shared test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from ledgerlens.queries.registry import ORACLE, QUERIES
from ledgerlens.queries import (  # noqa: F401  (importing registers the queries)
    cards, catalog, monitoring, relational, report, scalar, usage,
)

__all__ = ["ORACLE", "QUERIES"]
