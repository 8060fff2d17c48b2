"""Every operator as a query over the test tables, with its oracle SQL."""

from tallybook.catalog import (  # noqa: F401
    balance_queries,
    ingest_queries,
    lot_queries,
    report_queries,
)
from tallybook.catalog.registry import QUERIES

__all__ = ["QUERIES"]
