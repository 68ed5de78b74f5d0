"""All registered queries of the archive, and their SQL."""

from __future__ import annotations

from . import reports, stores, upkeep, writing

QUERIES = reports.QUERIES | stores.QUERIES | upkeep.QUERIES | writing.QUERIES  # one table, filled by all
SQL = reports.SQL | stores.SQL | upkeep.SQL | writing.SQL

__all__ = ["QUERIES", "SQL"]
