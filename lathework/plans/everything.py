"""All queries of the core engine: importing the plans registers them."""

from lathework.plans import ledger, scrolls  # noqa: F401
from lathework.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
