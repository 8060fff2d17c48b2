"""Tallybook: double-entry ledger and portfolio analytics as Spark jobs.

Every operator takes DataFrames and returns DataFrames; nothing is collected
to the driver except single-row scalars (a date range, a count).
"""

from tallybook.ledger import Ledger
from tallybook.session import configure

__all__ = ["Ledger", "configure"]
